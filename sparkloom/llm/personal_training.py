"""Labelled texts, made from rules, for the trees that judge personal mentions.

No text here comes from any corpus. Carriers are made of random everyday
words of public vocabularies around the mention, with and without a word that
says what it is, in the shapes texts have: running prose, settings, rows,
mails, logs, code, forms. Each shape is a family; the families in CALIBRATION
are kept from the trees and set the thresholds.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

from sparkloom.llm.personal import GIVEN, lexicon

CALIBRATION = ("table", "log", "speech", "sheet")

_ON = ["b", "br", "c", "d", "f", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "w", "z", "ch", "sh", "kh", "ny", "mb"]
_NU = ["a", "e", "i", "o", "u", "ei", "ou", "ie", "aa", "ü", "ö", "é"]
_CO = ["", "n", "r", "l", "s", "m", "nd", "rt", "ck", "x", "v", "ng", "nk"]
_ENDS = ["er", "sen", "mann", "ova", "ez", "ini", "ski", "ard", "ton", "berg", "ley", "eau", "o", "a", "i", "", "wala", "nathan", "oğlu", "ic", "escu", "ah", "moto", "son"]
#: Given names and surnames of many regions, none of them known to the features as such.
_NAMES = """Aaron Abena Adrián Aiko Alan Aleksandra Amit Anjali Arjun Babak Bjørn Camille Chen Daniela Deepak Diego Dmitri Ebru Emeka Emma Farah Fiona Gabriel George Hana Hao Helena Hiroshi Igor Ingeborg Isabella James Jamal
Jorge José Julia Kaito Kateryna Kenji Khalid Lakshmi Laura Leticia Li Mahmoud Manuel Mariana Matthew Maya Mei Michael Minh Mohammed Nikhil Nguyet Olivia Omar Oluwaseun Paolo Peter Piotr Rachel Rafael Rajesh Ricardo Robert Samir
Sanjay Sarah Sebastian Sergei Shreya Siobhan Sophie Stefan Takumi Thomas Tomasz Uchenna Valentina Vikram Wolfgang Xiaoming Yasmin Yuki Zainab Zsófia""".split()
_SURNAMES = """Adeyemi Alvarez Andersen Bauer Becker Bernard Bianchi Brown Chaudhary Chowdhury Davies Dubois Eriksson Fernández Fischer Fofana García Gonzalez Gupta Haddad Hansen Hernández Hoffmann Hughes Ivanov Jackson Johansson Kaya Kim Kowalski
Kuznetsov Lambert Larsen Lefebvre Lopez Martin Mbeki Mehta Meyer Miller Moreau Müller Nakamura Nguyen Novak O'Brien Okonkwo Osei Park Patel Petrov Pham Ramos Reddy Rossi Sánchez Sato Schneider Sharma Silva Smith Suzuki Tanaka Taylor
Tran Van Wagner Walker Wang Weber White Williams Wójcik Wright Wu Yamamoto Yılmaz Young Zhou Zimmermann""".split()
_PLACES = """New York|San Francisco|Los Angeles|Hong Kong|Buenos Aires|South Africa|New Zealand|Sri Lanka|Costa Rica|Great Britain|North America|United Nations|European Union|Silicon Valley|Lake Geneva|Cape Town|Tel Aviv|Saudi Arabia|Las Vegas|Puerto Rico""".split("|")
_PRODUCTS = """Visual Studio|Apache Spark|Google Cloud|Stack Overflow|Pull Request|Hello World|Amazon Web Services|Creative Commons|Red Hat|Jupyter Notebook|Linux Kernel|Unit Test|Source Code|Data Frame|Open Source|Machine Learning|Command Line|Merge Request|Quick Start
Known Issues|Getting Started|Table Of Contents|Release Notes|Stable Diffusion|Raspberry Pi|Mac OS|Windows Server|Internet Explorer|Unix Epoch|Monte Carlo|Bloom Filter|Fenwick Tree|Hidden Markov|Gaussian Noise|Fourier Transform|Black Friday|World Cup""".replace("\n", "|").split("|")
_GIVEN = sorted(GIVEN)
_TOPS = ["example", "invalid", "test", "com", "org", "net", "de", "fr", "es", "co.uk", "io", "edu", "it", "gov"]
_TITLES = ["Mr", "Mrs", "Ms", "Dr.", "Prof.", "Herr", "Frau", "Mme", "Sra.", "Dr", "Mr.", "Señor"]
_PARTICLES = ["von", "van", "de", "del", "de la", "van der", "di", "al", "bin"]
_JOIN = {
    "en": "the of and to in is that it for with as was this are be on not by which from or if when there our my every before after".split(),
    "de": "der die das und ist so nicht ein eine den dem mit auf für von zu im wird werden sind dass sich auch nur noch wenn dann wie".split(),
    "fr": "le la les des et est une un du dans que pas pour sur avec ce cette il elle qui au sont par plus quand".split(),
    "es": "el la los las y es una un del en que no por con para se su lo como más cuando esta este".split(),
}
#: Words that may stand before or after a mention of a kind; every other mention goes without.
_CUES = {
    "phone": "phone,tel.,call,mobile:,Telefon,Handy,téléphone,tél. :,móvil,teléfono:,fax,cell,dial,ring me on,reach me at,my number is,WhatsApp,Rufnummer,Nummer,hotline,contact number,text me at,joignable au,llámame al,erreichbar unter,desk,work:,portable".split(","),
    "id_number": (
        "SSN,social security number,SSN:,passport,passport no.,passport number is,passport #,Reisepass,Reisepass-Nr.,passeport n°,pasaporte,DNI,NIE,NIF,DNI:,CURP,CPF,national id,identity card,ID card no.,Personalausweis,Ausweisnummer,carte d'identité,tax id,tax number,TIN,Steuer-ID,Steuernummer,"
        "Steueridentifikationsnummer,numéro fiscal,NIR,numéro de sécurité sociale,driver's license,driving licence no.,Führerschein,permis de conduire,permiso de conducir,licence number,NI number,national insurance number,Sozialversicherungsnummer,codice fiscale,Aadhaar,PAN,BSN,PESEL,identification number,número de identidad"
    ).split(","),
    "address": "address:,address is,lives at,live at,I live at,ship to,send it to,delivered to,Adresse:,Anschrift,wohnt in der,wohne,habite au,habite,adresse :,dirección:,vive en,vivo en,home:,office at,house at,moved to,based at,billing address,parcel for,visit us at,street:".split(","),
    "name": "by,from,author:,contact,dear,hi,thanks,regards,name:,owner:,user,reviewer,cc,with,met,meet,asked,told,for,to,called,Herr,Frau,von,an,bei,mit,frag,heißt,ich bin,par,avec,contactez,je suis,chez,por,con,soy,pregunta a,me llamo,assignee,signed,patient,customer,colleague,my name is,written by,copyright".split(","),
    "email": "email,e-mail:,mail,write to,contact,reach me at,ping,from,to,cc,login,user,correo,adresse,schreib an,écris à,mailto".split(","),
}
_CODE_CUES = "step,build,version,range,job,checksum,line,size,seed,hash,epoch,port,ratio,loss,shard,commit,ticket,order,ISBN,rev,token,invoice,SKU,tracking,timestamp,offset,bytes,rows,issue,pid,error,serial,count,total,batch,run,lot,part no.,took,shape,uuid".split(",")
_PHONE_KEYS = ["phone", "tel", "mobile", "phone_number", "contact_phone", "fax", "telefon", "cell"]
_KEYS = {
    "phone": _PHONE_KEYS, "email": ["email", "mail", "e_mail", "contact", "user", "owner_email", "from", "correo"], "id_number": ["ssn", "passport", "passport_no", "tax_id", "national_id", "dni", "licence_no", "id_card", "steuer_id", "nir"],
    "address": ["address", "street", "ship_to", "billing_address", "home", "adresse", "direccion", "addr"], "name": ["name", "author", "owner", "full_name", "user", "customer", "contact", "reviewer", "patient", "nombre"],
}


@lru_cache(maxsize=1)
def _everyday() -> list[str]:
    return [w for w in lexicon().everyday() if len(w) > 2 and max(w) < "\u0180"]


@lru_cache(maxsize=1)
def _proper() -> list[str]:
    return [w for w in lexicon().proper() if max(w) < "\u0180"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lang = "en"

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def hexes(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def capitals(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))

    def shape(self, form: str) -> str:
        """form with each 9 a digit and each A a capital."""
        return "".join(self.digits(1) if c == "9" else self.capitals(1) if c == "A" else c for c in form)

    def coined(self) -> str:
        r = self.r
        return ("".join(r.choice(_ON) + r.choice(_NU) + r.choice(_CO) for _ in range(r.randint(1, 2))) + r.choice(_ENDS)).capitalize()

    def word(self) -> str:
        x = self.r.random()
        # rare words in lower case are known to the vocabularies with a capital only
        return self.r.choice(_JOIN[self.lang]) if x < 0.45 else self.r.choice(_proper()) if x < 0.52 else self.r.choice(_everyday())

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        w = self.words(4, 12)
        return w[0].upper() + w[1:] + self.r.choice([".", ".", ".", "?", "!", ":"])

    def identifier(self) -> str:
        return "_".join(self.r.choice(_everyday()) for _ in range(self.r.randint(1, 3)))

    # values

    def given(self) -> str:
        x = self.r.random()
        return self.r.choice(_NAMES) if x < 0.5 else self.r.choice(_GIVEN).capitalize() if x < 0.75 else self.coined() if x < 0.82 else self.r.choice(_proper()).capitalize()

    def family(self) -> str:
        x = self.r.random()
        out = self.r.choice(_SURNAMES) if x < 0.4 else self.coined() if x < 0.8 else self.r.choice(_proper()).capitalize() if x < 0.92 else self.r.choice(_everyday()).capitalize()
        if self.r.random() < 0.06:
            out += "-" + self.coined()
        if self.r.random() < 0.06:
            out = self.r.choice(_PARTICLES) + " " + out
        return out

    def name(self) -> str:
        r, given, family = self.r, self.given(), self.family()
        form = r.random()
        if form < 0.10:
            out = f"{given[0]}. {family}"
        elif form < 0.20:
            out = f"{family}, {given}" if r.random() < 0.8 else f"{family}, {given[0]}."
        elif form < 0.27:
            out = f"{given} {self.capitals(1)}. {family}"
        elif form < 0.33:
            out = f"{given} {family}".upper()
        elif form < 0.41:
            out = f"{r.choice(_TITLES)} {given} {family}"
        elif form < 0.44:
            out = f"{given}-{self.given()} {family}"
        elif form < 0.49:
            out = f"{given} {family}".lower()
        elif form < 0.55:
            out = f"{given} {self.given()} {family}"
        else:
            out = f"{given} {family}"
        return out.replace(" ", " ") if r.random() < 0.03 else out

    def email(self) -> str:
        r = self.r
        g, f = self.plain(self.given()), self.plain(self.family())
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}-{g}{r.randint(1, 99)}", f"{g}{r.randint(1, 9999)}", f"{g}_{f}", f"{g}_{f}+{r.choice(['ci', 'work', 'news'])}", f"{f}.{g[0]}", g, f"{r.choice(_everyday())}{r.randint(1, 99)}"])
        host = ".".join([*r.choice([[], [], ["mail"], ["lab"], ["home"]]), self.plain(r.choice([self.coined(), r.choice(_everyday())])), r.choice(_TOPS)])
        form = r.random()
        if form < 0.5:
            out = f"{local}@{host}"
        elif form < 0.62:
            a, d = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", "."), ("(at)", "."), (" [AT] ", "."), (" (arroba) ", ".")])
            out = f"{local}{a}{host.replace('.', d)}"
        elif form < 0.72:
            out = f"{local}(at){host}"
        elif form < 0.77:
            out = f"{local}＠{host}"
        elif form < 0.82:
            out = f"mailto:{local}{r.choice(['%40', '@'])}{host}"
        elif form < 0.85:
            out = f"{local}&#64;{host}"
        elif form < 0.88:
            out = f"{local} @ {host}"
        elif form < 0.92:
            out = f"{local} at {host.replace('.', ' dot ')}"
        elif form < 0.95:
            out = f"{local}{r.choice(['_at_', '-at-', '_AT_'])}{host}"
        else:
            out = f"{local}@{host}".upper()
        return out

    def plain(self, word: str) -> str:
        return "".join(c for c in word.lower() if "a" <= c <= "z") or "x"

    def phone(self) -> str:
        form = self.r.choice([
            "+44 20 9999 9999", "+49 30 99999999", "+49 99 99999 999", "(999) 999-9999", "999.999.9999", "999-999-9999", "00{}-999-999-9999", "001-999-999-9999", "+1(999)9999999", "+44 7999 999999", "0{} 99 99 99 99", "+33 {} 99 99 99 99", "020 9999 9999", "030/9999999", "030/999999",
            "tel:+1-999-999-9999", "+1 999 999 9999", "999-9999 ext. 99", "+34 999 999 999", "0999 999999", "+99999999999", "+49 (0) 99 9999999", "699 99 99 99", "+91 99999 99999", "+81 3-9999-9999", "07999 999999", "0{}.99.99.99.99", "+39 06 999 9999", "0999-9999999", "+1-999-999-9999", "(0999) 999-9999", "+86 139 9999 9999", "9999 999 999", "1-800-999-9999", "+41 79 999 99 99", "999 999 9999", "06{}9999999",
        ])
        out = self.shape(form.replace("{}", str(self.r.randint(1, 9))))
        return out.replace(" ", " ") if self.r.random() < 0.07 else out

    def id_number(self) -> tuple[str, bool]:
        """(number, whether its form alone tells what it is)."""
        bare = ["999-99-9999", "QQ 99 99 99 A", "AB999999C", "99999999-A", "1 99 99 99 999 999", "2 99 99 99 999 999 99", "A9999999-9", "AAAA999999AAAAAA99", "AAAAAA99A99A999A", "999.999.999-99", "99999999A", "X9999999A"]
        cued = ["999999999", "999 99 9999", "A9999999", "AA9999999", "ZZ999 9999", "99999999999", "A9999-99999-99999", "99 999 999 999", "A99999999", "9999999999", "9999 9999 9999", "A999-9999-9999", "99AA99999", "AAAAA9999A", "99999999", "C99AAA999", "99/999/99999", "9999 999999 99", "AAAAA999999AA9AA", "999-999-999", "A99 999 999"]
        if self.r.random() < 0.3:
            return self.shape(self.r.choice(bare)), True
        return self.shape(self.r.choice(cued)), False

    def address(self) -> str:
        r = self.r
        if r.random() < 0.15:  # common words as names of streets
            street = r.choice(["Elm", "Oak", "Church", "High", "Mill", "Station", "Main", "Park", "Mayor", "Real", "Haupt", "Bahnhof", "Garten", "Kirch"])
            return f"{r.randint(1, 199)} {street} {r.choice(['Road', 'Street', 'Lane', 'Ave'])}" if r.random() < 0.5 else f"{r.choice(['Calle', 'Plaza', 'Avenida'])} {street} {r.randint(1, 199)}"
        n = str(r.randint(1, 1999)) + r.choice(["", "", "", "a", "B", "/2"])
        street = r.choice([self.coined(), self.coined(), r.choice(_everyday()).capitalize(), r.choice(_SURNAMES), f"{r.choice(_everyday()).capitalize()} {self.coined()}"])
        low = f"{r.choice(_everyday())}"
        return r.choice([
            lambda: f"{n} {street} {r.choice(['Street', 'Road', 'Lane', 'Avenue', 'Terrace', 'Court', 'Drive', 'Place', 'Square', 'Way', 'Close', 'Crescent', 'Hill', 'Grove', 'Parkway'])}",
            lambda: f"{n} {street} {r.choice(['St.', 'Rd', 'Ln', 'Ave', 'Blvd', 'Dr.', 'Ct', 'St', 'Ave.'])}", lambda: f"{n} {r.choice('NSEW')}. {street} {r.choice(['Blvd', 'Ave', 'St.'])}", lambda: f"{n} {r.randint(3, 99)}th {r.choice(['Street', 'Ave', 'St'])}",
            lambda: f"{n} {low} {r.choice(['street', 'road', 'lane', 'avenue'])}",
            lambda: f"{street.split()[0]}{r.choice(['straße', 'weg', 'allee', 'gasse', 'platz', 'strasse', 'str.', 'ring', 'damm'])} {r.randint(1, 150)}{r.choice(['', '', 'a', ' b', '-7'])}", lambda: f"{street.split()[0]}er {r.choice(['Straße', 'Weg', 'Allee', 'Str.', 'Platz', 'Ufer'])} {r.randint(1, 150)}",
            lambda: f"{r.choice(['Am', 'Im', 'An der', 'Auf dem', 'Unter den', 'Zum'])} {street.split()[0]} {r.randint(1, 150)}",
            lambda: f"{r.randint(1, 150)}{r.choice(['', ' bis', ' ter'])}{r.choice(['', ','])} {r.choice(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'impasse', 'quai', 'allée'])} {r.choice(['de la ', 'du ', 'des ', 'de ', '', chr(39).join(['de l', ''])])}{street}",
            lambda: f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Paseo', 'Camino', 'C/', 'Avda.', 'Ronda', 'calle'])} {r.choice(['', 'del ', 'de la ', 'de ', 'Gran '])}{street}{r.choice(['', ','])} {r.choice(['', '', 'n.º '])}{r.randint(1, 150)}",
            lambda: f"{r.choice(['Via', 'Viale', 'Piazza', 'Corso', 'Rua', 'Travessa', 'ul.'])} {r.choice(['', 'della ', 'da '])}{street} {r.randint(1, 150)}", lambda: f"{street.split()[0]}{r.choice(['straat', 'laan', 'gracht', 'gatan'])} {r.randint(1, 150)}",
        ])()

    def town(self) -> str:
        return self.r.choice([f", {self.digits(5)} {self.coined()}", f", {self.coined()}", f", Apt {self.r.randint(1, 30)}B, {self.coined()} {self.digits(5)}", "", "", f",\n{self.coined()} {self.digits(5)}", f", {self.coined()}, {self.capitals(2)} {self.digits(5)}", f" in {self.coined()}"])

    # what looks alike

    def thing(self) -> str:
        """Capitalised words that name nobody."""
        r, e = self.r, _everyday()
        return r.choice([
            lambda: f"{r.choice(e).capitalize()} {r.choice(e).capitalize()}", lambda: f"{r.choice(e).capitalize()} {r.choice(e).capitalize()} {r.choice(e).capitalize()}", lambda: r.choice(_PLACES), lambda: r.choice(_PRODUCTS), lambda: f"{self.coined()} {r.choice(['Inc', 'GmbH', 'Ltd', 'Corp', 'University', 'Institute', 'Bank', 'Foundation', 'Team', 'Project'])}",
            lambda: f"{r.choice(e).capitalize()} {r.choice(_proper()).capitalize()}", lambda: f"{self.coined()}{self.coined()} {self.coined()}{r.choice(['Error', 'Handler', 'Type', 'Test'])}", lambda: f"{r.choice(['The', 'Each', 'When', 'Only', 'If', 'Die', 'Le', 'El', 'After', 'Every'])} {r.choice([self.coined(), r.choice(_proper()).capitalize()])}",
            lambda: f"{r.choice(['Monday', 'Friday', 'March', 'June', 'Windows', 'Python', 'Linux'])} {r.choice(e).capitalize()}", lambda: f"{r.choice(e).capitalize()}, {r.choice(e).capitalize()}", lambda: f"{r.choice(e)} {r.choice(e)}".upper(), lambda: f"{self.coined()} {r.choice(e).capitalize()}", lambda: f"{self.coined()}'s {r.choice(e).capitalize()} {r.choice(e).capitalize()}",
            lambda: f"{r.choice(['Golden', 'Silver', 'Red', 'Blue', 'Black', 'North', 'Royal', 'Iron', 'Ruby', 'Amber', 'Rapid', 'Quiet'])} {r.choice(_proper() if r.random() < 0.5 else e).capitalize()}", lambda: f"{r.choice(_proper())} {r.choice(e)}",
        ])()

    def number(self) -> str:
        """A number that is nobody's, with the word beside it."""
        r, d = self.r, self.digits
        cue = r.choice(_CODE_CUES)
        return r.choice([
            lambda: f"{cue} {d(r.randint(5, 12))}", lambda: f"{cue}={d(r.randint(4, 11))}", lambda: f"{cue} {d(3)}-{d(4)}", lambda: f"{cue}: {d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", lambda: f"2026-0{d(1)}-{d(2)} {d(2)}:{d(2)}:{d(2)} {cue} {d(3)} {d(3)} ms", lambda: f"{d(1)}.{d(12)}", lambda: f"v{d(2)}.{d(3)}.{d(4)}-{d(3)}",
            lambda: f"[{d(2)}, {d(3)}, {d(4)}, {d(3)}]", lambda: f"@@ -{d(3)},{d(1)} +{d(3)},{d(1)} @@", lambda: f"10.{r.randint(0, 99)}.{d(2)}.{d(2)}:{d(4)}", lambda: f"0x{self.hexes(10)}", lambda: f"{cue} {self.hexes(8)} {self.hexes(8)}", lambda: f"{self.hexes(8)}-{d(4)}-{d(4)}-{d(4)}-{d(12)}", lambda: f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            lambda: f"{cue} {self.shape(r.choice(['AA99999', 'A9999999', 'AAA-99999', '99999-99', '9999-99-9999', 'AA-9999-9999', '999999999', '9999 9999']))}", lambda: f"{d(3)} {d(3)} {cue}", lambda: f"test_{d(4)}.py::case[{d(4)}-{d(4)}]", lambda: f"2026{d(4)}.{d(8)}", lambda: f"{d(2)}/{d(2)}/20{d(2)} {d(2)}:{d(2)}", lambda: f"{cue} {d(4)}, {d(4)} and {d(5)}", lambda: f"UTC+{d(2)}{d(2)}{d(5)}", lambda: f"{d(5)}:{d(7)}",
        ])()

    def machine(self) -> str:
        """An at sign that is no person's mail."""
        d, r, i = self.digits, self.r, self.identifier
        host = f"{self.plain(self.coined())}.{r.choice(_TOPS)}"
        return r.choice([
            lambda: f"git clone git@{host}:{i()}/{i()}.git", lambda: f"pip install {i()}@{d(1)}.{d(1)}.{d(4)}", lambda: f"@{i()}(size={d(3)})", lambda: f"{i()} @ {i()}", lambda: f"ssh root@{i()}-{d(2)}.internal:{d(4)}", lambda: f"npm i @{i()}/{i()}@{d(1)}.{d(2)}.{d(1)}", lambda: f"scp {i()}.txt deploy@{host}:/srv", lambda: f"uses: {i()}/{i()}@v{d(1)}",
            lambda: f"https://{i()}:{self.hexes(8)}@{host}/{i()}.git", lambda: f"postgres://{i()}@{i()}.internal:5432/db", lambda: f"rsync -a ubuntu@10.0.{d(1)}.{d(2)}:/data .", lambda: f"image: {host}/{i()}@sha256:{self.hexes(12)}", lambda: f"meet at {i()} dot", lambda: f"noreply@{host}", lambda: f"remote: hg@{host}/{i()}",
        ])()

    def place(self) -> str:
        """Capitalised words and a number that are no address."""
        r, e = self.r, _everyday()
        return r.choice([
            lambda: f"{r.choice(['Step', 'Table', 'Figure', 'Section', 'Chapter', 'Python', 'Case', 'Level', 'Run', 'Part', 'Phase', 'Test', 'June', 'Page'])} {r.randint(1, 99)}", lambda: f"{r.randint(1, 99)} {r.choice(e).capitalize()} {r.choice(e)} {r.choice(e)}", lambda: f"{r.choice(e).capitalize()} {r.choice(e).capitalize()} {r.randint(1, 99)}",
            lambda: f"{r.randint(1, 99)} {r.choice(e).capitalize()} {r.choice(['Way', 'Row', 'Place', 'Block', 'Lane'])} {r.choice(e)} {r.choice(e)}", lambda: f"{r.choice(['Street', 'Road', 'Calle', 'Avenue'])} {r.choice(e)} {r.choice(e)} {r.randint(1, 20)}", lambda: f"{self.coined()} {r.randint(1, 99)}", lambda: f"{r.randint(1, 31)} {r.choice(['March', 'May', 'June'])} 20{self.digits(2)}",
            lambda: f"{r.randint(100, 999)} {self.coined()} {self.coined()}", lambda: f"send {r.randint(1, 99)} {r.choice(e).capitalize()} {r.choice(e)}", lambda: f"{r.randint(2, 60)} {r.choice(['Lane', 'Drive', 'Place', 'Square'])} {r.choice(e).capitalize()} {r.choice(e)}",
        ])()

    # carriers

    def value(self, kind: str) -> tuple[str, bool]:
        if kind == "id_number":
            return self.id_number()
        if kind == "address":
            return self.address(), self.r.random() < 0.8
        return getattr(self, kind)(), True

    def prose(self, kind: str) -> list[tuple[str | None, str]]:
        r = self.r
        value, alone = self.value(kind)
        cue = r.choice(_CUES[kind]) if not alone or r.random() < (0.4 if kind == "name" else 0.6) else ""
        if cue and r.random() < 0.4:
            cue = cue.capitalize()
        before = self.words(0, 6) if kind != "name" or r.random() < 0.7 else ""
        if kind == "name" and not before and r.random() < 0.6:
            cue = ""  # a name that opens a sentence
        if before and r.random() < 0.5:
            before = before.capitalize()
        head = " ".join(x for x in (before, cue) if x)
        after = r.choice(["", "", ".", ",", "!", ";", " "]) + (" " + self.words(1, 6) if r.random() < 0.6 else "")
        follow = [(None, self.town())] if kind == "address" else []
        if r.random() < 0.2 and kind != "address":
            extra = r.choice(["name", "email", "phone", "phone", "address"])
            follow = [(None, r.choice([", ", " (", " <", " - ", " / ", " or ", ": ", " ", "\n"])), (extra, getattr(self, extra)()), (None, r.choice([")", ">", "", "."]))]
        return [(None, head + r.choice([" ", " ", " ", ": ", "\n"]) if head else ""), (kind, value), *follow, (None, after)]

    def speech(self, kind):
        self.lang = self.r.choice(["en", "de", "fr", "es"])
        return [(None, self.r.choice(["> ", "- ", "* ", "\"", "[12:04] ", ""])), *self.prose(kind), (None, self.r.choice(["\"", "\n", "..."]))]

    def settings(self, kind):
        r = self.r
        key, q = r.choice(_KEYS[kind]), r.choice(["", "", "\"", "'"])
        value, _ = self.value(kind)
        sep = r.choice([": ", " = ", "=", ":", ": ", "\t"])
        return [(None, f"{self.identifier()}{sep}{q}{self.identifier()}{q}\n{q}{key}{q}{sep}{q}"), (kind, value), (None, f"{q}{r.choice(['', ','])}\n")]

    def columns(self, kind, sep):
        r = self.r
        kinds = [kind, *r.sample([k for k in _KEYS if k != kind], r.randint(0, 2))]
        r.shuffle(kinds)
        out: list[tuple[str | None, str]] = []
        if r.random() < 0.5 or "id_number" in kinds:
            out.append((None, sep.join(["id", *(r.choice(_KEYS[k]) for k in kinds)]) + "\n"))
        out.append((None, f"{r.randint(1, 999)}"))
        for k in kinds:
            label = r.choice(_CUES[k]) + " " if k == "id_number" and len(out) < 2 else ""
            out += [(None, sep + label), (k, self.value(k)[0])]
        return [*out, (None, "\n")]

    def table(self, kind):
        return self.columns(kind, " | ")

    def sheet(self, kind):
        return self.columns(kind, self.r.choice([";", ", ", "\t"]))

    def rows(self, kind):
        return self.columns(kind, self.r.choice([",", "|", " ; "]))

    def mail(self, kind):
        r = self.r
        head = [(None, r.choice(["From: ", "To: ", "Cc: ", "Author: ", "Reviewed-by: ", "Acked-by: ", "Von: ", "De: "])), ("name", self.name()), (None, " <"), ("email", self.email()), (None, ">\n")]
        close = [(None, r.choice(["Best,\n", "Kind regards\n", "Viele Grüße\n", "Bien à vous,\n", "Un saludo,\n", "-- \n", "Cheers, "])), ("name", self.name()), (None, "\n"), *([("address", self.address()), (None, self.town() + "\n")] if r.random() < 0.3 else [])]
        body = [(None, self.sentence() + "\n"), *self.prose(kind), (None, "\n")]
        return [*(head if r.random() < 0.6 else []), *body, *(close if r.random() < 0.6 else [])]

    def log(self, kind):
        r = self.r
        value, alone = self.value(kind)
        cue = r.choice(_KEYS[kind]) + r.choice(["=", ": ", " "]) if not alone or r.random() < 0.7 else self.word() + " "
        return [(None, f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)} {r.choice(['INFO', 'WARN', 'DEBUG', 'ERROR'])} {self.words(1, 4)} {cue}"), (kind, value), (None, f" {self.words(0, 3)}\n")]

    def code(self, kind):
        r = self.r
        value, alone = self.value(kind)
        note = r.choice(_CUES[kind]) if not alone or r.random() < 0.5 else ""
        q = r.choice("\"'")
        return r.choice([
            lambda: [(None, f"# {self.words(0, 3)} {note} "), (kind, value), (None, "\n")], lambda: [(None, f"// {note}: "), (kind, value), (None, "\n")], lambda: [(None, f"{r.choice(_KEYS[kind])} = {q}"), (kind, value), (None, f"{q}\n")], lambda: [(None, f"{{\"{r.choice(_KEYS[kind])}\": \""), (kind, value), (None, "\"}")],
            lambda: [(None, f"assert {self.identifier()}({q}{note} "), (kind, value), (None, f"{q}) is None\n")], lambda: [(None, f"<!-- {note} "), (kind, value), (None, " -->\n")], lambda: [(None, f"[({q}"), ("name", self.name()), (None, f"{q}, {q}"), ("phone", self.phone()), (None, f"{q})]\n")], lambda: [(None, f"{q}"), (kind, value), (None, f"{q},  # {note or self.words(1, 3)}\n")],
        ])()

    def decoy(self) -> str:
        r = self.r
        what = r.choice([self.thing, self.thing, self.thing, self.number, self.number, self.number, self.machine, self.place])()
        form = r.random()
        if form < 0.35:
            return f"{self.words(1, 5).capitalize()} {what} {self.words(0, 4)}" + r.choice([".", ".", ",", ""])
        if form < 0.5:
            return what + r.choice([".", "", ":", "\n"])
        if form < 0.6:
            return f"# {what}\n"
        if form < 0.7:
            return f"{r.choice(_CUES['name'])} {self.word()}, {what} {self.words(0, 3)}."
        if form < 0.8:
            return f"{self.identifier()}: {what}\n"
        return f"{what} {self.words(1, 5)}" + r.choice([".", "?", ":"])


FAMILIES = ("prose", "prose", "prose", "settings", "rows", "mail", "code", "code", *CALIBRATION)


def labelled_texts(count: int, seed: int = 20260, families: tuple[str, ...] = FAMILIES) -> Iterator[tuple[str, list[tuple[str, int, int]], str]]:
    """(text, [(kind, start, end)], family) with mentions among plain sentences and look-alikes."""
    m = Maker(seed)
    kinds = list(_KEYS)
    for _ in range(count):
        m.lang = m.r.choice(["en", "en", "de", "fr", "es"])
        text, truth, family = "", [], m.r.choice(families)
        for _ in range(m.r.randint(1, 3)):
            if m.r.random() < 0.5:
                text += m.sentence() + m.r.choice([" ", "\n"])
            if m.r.random() < 0.6:
                text += m.decoy() + m.r.choice([" ", "\n", "\n"])
            if m.r.random() < 0.5:
                for kind, piece in getattr(m, family)(m.r.choice(kinds)):
                    if kind:
                        truth.append((kind, len(text), len(text) + len(piece)))
                    text += piece
                text += m.r.choice([" ", "\n", "\n"])
        yield text + m.sentence(), truth, family
