"""Small pieces of oracle SQL shared by the catalogue."""

from __future__ import annotations

from sparkloom.functions.cleaning import LANGUAGE_NAMES
from sparkloom.operators.tokens import LEXER

TOKENS = f"regexp_extract_all(text, '{LEXER}', 0)"
#: (doc_id, pos, token) of the documents.
TOK = f"SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"


def language(column: str) -> str:
    base = f"lower(regexp_extract(trim(coalesce({column}, '')), '^([^-_]*)', 1))"
    whens = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in LANGUAGE_NAMES.items())
    return f"CASE {base} WHEN '' THEN 'unknown' {whens} ELSE {base} END"


def label(column: str) -> str:
    t = f"regexp_replace(lower(trim(coalesce({column}, ''))), '[-\\s]+', '_', 'g')"
    return f"CASE WHEN {t} = '' THEN 'unknown' ELSE {t} END"


ROLE = """CASE WHEN lower(trim(coalesce(m.role, ''))) IN ('', 'user', 'prompter', 'human') THEN 'user' WHEN lower(trim(m.role)) = 'system' THEN 'system'
 WHEN lower(trim(m.role)) IN ('tool', 'observation', 'environment', 'function', 'tool_result') THEN 'tool_result' ELSE 'assistant' END"""
SEGMENTS = f"""list_concat(list_concat(list_concat(list_concat(
 CASE WHEN trim(coalesce(system, '')) <> '' THEN [{{'tag': 'system', 'body': system}}] ELSE [] END,
 CASE WHEN trim(coalesce(repo_context, '')) <> '' THEN [{{'tag': 'repo_context', 'body': repo_context}}] ELSE [] END),
 coalesce(list_transform(list_filter(messages, lambda m: m IS NOT NULL AND trim(coalesce(m.content, '')) <> ''), lambda m: {{'tag': {ROLE}, 'body': m.content}}), [])),
 coalesce(list_transform(list_filter(trace, lambda t: trim(coalesce(t.content, '')) <> ''), lambda t: {{'tag': CASE t.type WHEN 'tool_call' THEN 'tool' WHEN 'tool_result' THEN 'tool_result' WHEN 'patch' THEN 'patch' WHEN 'test_output' THEN 'test_output' ELSE 'assistant' END, 'body': t.content}}), [])),
 CASE WHEN trim(coalesce(final, '')) <> '' THEN [{{'tag': 'final', 'body': final}}] ELSE [] END)"""
#: One row per record and delivery, with the rendering.
RENDERED = f"""SELECT *, CASE WHEN text IS NOT NULL THEN text ELSE array_to_string(list_transform(segs, lambda s: '<|' || s.tag || '|>' || chr(10) || s.body), chr(10)) || chr(10) END AS rendered,
 CASE WHEN text IS NOT NULL THEN text ELSE array_to_string(list_transform(segs, lambda s: s.body), chr(10)) END AS plain FROM (SELECT *, {SEGMENTS} AS segs FROM agentcoder_slice_train)"""
#: One row per run and step; NaN is null; the latest arrival counts.
LOG = """SELECT run_id, global_step, r.* FROM (SELECT run_id, global_step, max({'arrived_at': arrived_at, 'tokens_seen': tokens_seen, 'train_loss': train_loss, 'next_token_loss': next_token_loss,
 'learning_rate': learning_rate, 'grad_norm': grad_norm, 'tokens_per_sec': tokens_per_sec, 'step_time_ms': step_time_ms, 'val_next_token_loss': val_next_token_loss, 'mixer_backend': mixer_backend, 'logged_at': logged_at}) AS r
 FROM (SELECT * REPLACE (CASE WHEN isnan(train_loss) THEN NULL ELSE train_loss END AS train_loss, CASE WHEN isnan(next_token_loss) THEN NULL ELSE next_token_loss END AS next_token_loss,
 CASE WHEN isnan(val_next_token_loss) THEN NULL ELSE val_next_token_loss END AS val_next_token_loss, CASE WHEN isnan(grad_norm) THEN NULL ELSE grad_norm END AS grad_norm) FROM train_log)
 WHERE run_id IS NOT NULL AND global_step IS NOT NULL GROUP BY run_id, global_step)"""
#: Distinct eval results.
RESULTS = "SELECT DISTINCT * FROM eval_results"
