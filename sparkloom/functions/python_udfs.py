"""The few functions Spark has no primitive for, vectorised over Arrow batches."""

from __future__ import annotations

import ast
import difflib
import json
import re
import subprocess
import sys

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parse(code: str | None):
    try:
        return ast.parse(code) if code is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.BooleanType())
def python_syntax_ok(code: pd.Series) -> pd.Series:
    """Whether the code parses; null for null."""
    return code.map(lambda c: None if c is None else _parse(c) is not None)


@F.pandas_udf(T.StringType())
def first_function_name(code: pd.Series) -> pd.Series:
    """Name of the first top-level function, null without one."""

    def name(c):
        tree = _parse(c)
        return next((n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None) if tree else None

    return code.map(name)


@F.pandas_udf(T.ArrayType(T.StringType()))
def unified_diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines of the unified diff with a/ and b/ headers; empty for equal texts, null for a null one."""

    def lines(p, a, b):
        if a is None or b is None:
            return None
        return list(difflib.unified_diff(a.splitlines(), b.splitlines(), f"a/{p}", f"b/{p}", lineterm=""))

    return pd.Series([lines(p, a, b) for p, a, b in zip(path, old, new)], dtype=object)


def embedded_json(text: str | None) -> str | None:
    """First JSON object in text: from the first brace that opens one, decoded as far as it goes."""
    if text is None:
        return None
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return json.dumps(value, sort_keys=True)
        except (ValueError, RecursionError):
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    return text.map(embedded_json)


def any_json(text: str | None) -> str | None:
    """The text as JSON if it is such as a whole but for begin and end markers, else its first JSON object; keys sorted."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text.replace("<eos>", "").replace("<bos>", "").strip()), sort_keys=True)
    except (ValueError, RecursionError):
        return embedded_json(text)


@F.pandas_udf(T.StringType())
def json_value(text: pd.Series) -> pd.Series:
    return text.map(any_json)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The text as JSON with sorted keys; null where it is none as a whole."""

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True)
        except (ValueError, RecursionError):
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def decode_tokens(tokens: pd.Series) -> pd.Series:
    """Text of ARRAY<STRING> tokens; runs of <0xHH> become UTF-8 text, invalid bytes a replacement sign."""

    def one(row):
        if row is None:
            return None
        out, run = [], bytearray()
        for t in row:
            if t is not None and len(t) == 6 and t.startswith("<0x") and t.endswith(">"):
                run.append(int(t[3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(t or "")
        return "".join(out) + run.decode("utf-8", "replace")

    return tokens.map(one)


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def applies(patch: str, files: dict[str, str]) -> bool:
    """Whether a unified diff can be applied to files (path to text): paths known, counts as stated, every old line found.

    A hunk may stand elsewhere than stated, as long as its old lines are found
    in a row behind the hunk before it.
    """
    lines, at, seen = patch.splitlines(), 0, 0
    while at < len(lines):
        if not (lines[at].startswith("--- ") and at + 1 < len(lines) and lines[at + 1].startswith("+++ ")):
            at += 1
            continue
        path = re.sub(r"^a/", "", lines[at][4:].split("\t")[0].strip())
        if path not in files:
            return False
        text, behind, at = files[path].splitlines(), 0, at + 2
        while at < len(lines) and (m := _HUNK.match(lines[at])):
            old_n, new_n = int(m.group(2) or 1), int(m.group(4) or 1)
            old, new, at = [], [], at + 1
            while at < len(lines) and (len(old) < old_n or len(new) < new_n):
                sign, body = lines[at][:1] or " ", lines[at][1:]
                if sign not in " -+":
                    return False
                old += [body] if sign in " -" else []
                new += [body] if sign in " +" else []
                at += 1
            places = [p for p in range(behind, len(text) - len(old) + 1) if text[p : p + len(old)] == old]
            if len(old) != old_n or len(new) != new_n or not places:
                return False
            behind, seen = min(places, key=lambda p: abs(p + 1 - int(m.group(1)))) + len(old), seen + 1
    return seen > 0


def patch_check(files: dict[str, str]):
    """UDF (text) -> 1.0 where the text is a patch that applies to the files, else 0.0; null for null."""

    @F.pandas_udf(T.DoubleType())
    def check(patch: pd.Series) -> pd.Series:
        return patch.map(lambda p: None if p is None else float(applies(p, files)))

    return check


def test_runner(enabled: bool = False, seconds: int = 5, memory_mb: int = 512):
    """UDF (code, tests) -> passed. Runs untrusted code, so it must be switched on; off, it returns null.

    A separate interpreter without site packages, with limits on time, memory
    and files. The limits are no security boundary: run it in a sandbox.
    """

    @F.pandas_udf(T.BooleanType())
    def run(code: pd.Series, tests: pd.Series) -> pd.Series:
        def one(c, t):
            if not enabled or c is None or t is None:
                return None
            import resource

            def limit():
                resource.setrlimit(resource.RLIMIT_CPU, (seconds, seconds))
                resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
                resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))

            try:
                done = subprocess.run([sys.executable, "-I", "-S", "-c", f"{c}\n{t}\n"], preexec_fn=limit, capture_output=True, timeout=seconds * 2)
                return done.returncode == 0
            except (subprocess.TimeoutExpired, OSError):
                return False

        return pd.Series([one(c, t) for c, t in zip(code, tests)], dtype=object)

    return run
