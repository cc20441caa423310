"""Surrogates for personal data.

Entities are found by patterns with checks (Luhn, mod 97, octet ranges, titles or known
first names before surnames) and each is replaced by a surrogate of its own type and format.

Addresses, numbers, cards, keys and secrets get a keyed permutation of their canonical form
within its class: the class fixes what must stay (country prefix, card type and validity,
address class of an IP, the places of letters, digits and punctuation), and the permutation
is a Feistel network walked in cycles until it is back in the class. A permutation is
one-to-one, so two of them never share a surrogate.

Names are parted into first names, with the gender that a title, the lists or their form
give, and surnames. A listed first name becomes another of its list; any other is written
anew from syllables of its script, with an ending of its gender, chosen by a keyed digest.
Once a person is found in a text, every later or earlier mention of that first name or
surname in it is replaced, too. As digests can meet, the distinct names of all texts are
checked before any is replaced: of names that share a surrogate all but the first get a
salt, until none share one.

One entity has the same surrogate in every document. collisions() checks all of it again
over a corpus.

Defined results: a null text stays null with no entities; a text without entities stays as
it is; overlapping finds go to the one that starts first, then to the order of the patterns;
repeated rows are treated alike; every other column passes through, but columns of the input
called n_entities or entity_types are replaced where counts are asked for; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..storage import Written
from .common import slices, table

#: The key of the query; production passes its own secret.
KEY = b"surrogates"
ROUNDS = 8
#: Characters permuted together.
BLOCK = 64

# First names by gender and script, replaced by others of the same list.
NAMES = {
    "f": "Alice Amelia Anna Barbara Carla Carmen Charlotte Clara Elena Elisabeth Emily Emma Eva Frances Greta Hannah Helen Ingrid Irene Isabel Jane Julia Karin Laura Linda Lucia Margaret Maria Marie Martha Mary Monica Nina Olivia Paula Petra Rachel Rosa Sarah Sophie Susan Teresa Ursula Vera".split(),
    "m": "Adam Albert Alexander Andrew Anton Arthur Carlos Charles Daniel David Diego Edward Emil Felix Francis Frank George Hans Henry Hugo Ivan Jack James Jean John Jorge Joseph Juan Karl Louis Lucas Marc Martin Max Michael Oliver Oscar Pablo Paul Peter Pierre Robert Samuel Stefan Thomas Walter William".split(),
    "fc": "Александра Анна Вера Виктория Галина Дарья Екатерина Елена Ирина Любовь Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    "mc": "Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Сергей".split(),
}
# Titles that stand before a name, by gender where they have one.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Srta Doña".split(),
    "": "Dr Prof Professor Doctor".split(),
}

# Syllables (onsets, vowels, codas) of written surrogates by script, and endings of female and male first names and of surnames.
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v w br dr gr kl tr".split(), "a e i o u".split(), ["", "l", "n", "r"]),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х бр др кр тр".split(), "а е и о у".split(), ["", "л", "н", "р"]),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ χ βρ γρ δρ κρ πρ τρ".split(), "α ε η ι ο".split(), ["", "λ", "ν", "ρ"]),
}
ENDINGS = {
    "latin": {"f": "a ia ina ela ita ena ora isa".split(), "m": "an en ias ard ol ert in on".split(), "s": "er man sen ini ell off ard ez".split()},
    "cyrillic": {"f": "а ия ина ела ита ена ора иса".split(), "m": "ан ен ий ард ол ерт ин он".split(), "s": "ов ин енко ский ев ук ян ич".split()},
    "greek": {"f": "α ια ινα ελα ιτα ενα ορα ισα".split(), "m": "ος ης ας ιος ων ανος ινος ερης".split(), "s": "ιδης ακης ου ας ογλου ιας ατος ινος".split()},
}

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
CYR = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ALPHABETS = [DIGITS, LOWER, UPPER, CYR, CYR.upper(), GREEK, GREEK.upper(), ACCENTED, "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
_OF = {c: a for a in ALPHABETS for c in a}


def permuted(value: int, size: int, key: bytes, tweak: str, allowed: Callable[[int], bool] = lambda v: True) -> int:
    """A keyed permutation of the allowed values under size; value must be allowed itself."""
    if size < 2:
        return value
    half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    salt = tweak.encode("utf-8", "replace")
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            mac = hashlib.blake2b(bytes([r]) + right.to_bytes(width, "big") + salt, key=key, digest_size=max(8, width)).digest()
            left, right = right, left ^ (int.from_bytes(mac, "big") & mask)
        value = left << half | right
        if value < size and allowed(value):
            return value


def _blocks(text: str) -> Iterator[tuple[str, str]]:
    """Each block of a text, with a digest of all before it."""
    before = hashlib.blake2b(digest_size=16)
    for i in range(0, len(text), BLOCK):
        yield text[i : i + BLOCK], before.hexdigest()
        before.update(text[i : i + BLOCK].encode("utf-8", "replace"))


def reshaped(text: str, key: bytes, tweak: str, allowed: Callable[[str], bool] = lambda s: True, alphabets: dict[str, str] = _OF) -> str:
    """Another text with each character from the same alphabet; characters of no alphabet stay.

    A long text is taken in blocks, each under a tweak that holds all before it, which is one-to-one, too.
    """
    if len(text) > BLOCK:
        return "".join(reshaped(x, key, f"{tweak}|{len(text)}|{before}", allowed, alphabets) for x, before in _blocks(text))
    at = [(i, alphabets[c]) for i, c in enumerate(text) if c in alphabets]
    size, value = 1, 0
    for i, a in at:
        value = value * len(a) + a.index(text[i])
        size *= len(a)
    shape = "".join({id(a): chr(65 + k) for k, a in enumerate([HEX, *ALPHABETS])}.get(id(alphabets[c]), "?") if c in alphabets else c for c in text)

    def spelled(v: int) -> str:
        out = list(text)
        for i, a in reversed(at):
            v, r = divmod(v, len(a))
            out[i] = a[r]
        return "".join(out)

    return spelled(permuted(value, size, key, f"{tweak}|{shape}", lambda v: allowed(spelled(v))))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _in_format(found: str, canonical: str) -> str:
    """The canonical characters in the places of the letters and digits of the text found."""
    it = iter(canonical)
    return "".join(next(it) if c.isalnum() else c for c in found)


# ---- one function for each type: the canonical form of a find, and its surrogate ----


def _email(c: str, key: bytes) -> str:
    local, _, domain = c.partition("@")
    head, dot, top = domain.rpartition(".")
    first, more, rest = head.partition(".")
    fixed = f"{more}{rest}{dot}{top}"
    return f"{reshaped(local, key, 'email')}@{reshaped(first, key, 'domain')}{fixed}"


def _phone(c: str, key: bytes) -> str:
    keep = len(c) - 10 if len(c) > 10 else min(3, len(c) // 3)
    low = c[keep] in "01"
    return c[:keep] + reshaped(c[keep:], key, f"phone{c[:keep]}{low}", lambda s: (s[0] in "01") == low)


def _card(c: str, key: bytes) -> str:
    body = c[0] + reshaped(c[1:-1], key, f"card{c[0]}{len(c)}")
    return next(body + d for d in DIGITS if luhn(body + d))


#: Address blocks within which an address stays (first address, prefix length).
BLOCKS = [(10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (0, 8), (224 << 24, 3)]


def _ip_block(v: int) -> tuple[int, int] | None:
    return next(((b, n) for b, n in BLOCKS if v >> (32 - n) == b >> (32 - n)), None)


def _ip(c: str, key: bytes) -> str:
    a, b, d, e = map(int, c.split("."))
    v = a << 24 | b << 16 | d << 8 | e
    block = _ip_block(v)
    if block:
        size = 1 << (32 - block[1])
        v = block[0] + permuted(v - block[0], size, key, f"ip{block[0]}")
    else:
        v = permuted(v, 1 << 32, key, "ip", lambda x: _ip_block(x) is None)
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


def _iban(c: str, key: bytes) -> str:
    body = reshaped(c[4:], key, f"iban{c[:2]}")
    check = 98 - int("".join(str(int(x, 36)) for x in body + c[:2] + "00")) % 97
    return f"{c[:2]}{check:02d}{body}"


_IS_HEX = re.compile("[0-9a-f]*").fullmatch


def _secret(c: str, key: bytes) -> str:
    if _IS_HEX(c):
        return reshaped(c, key, "hex", alphabets=dict.fromkeys(HEX, HEX))
    # a block that is hexadecimal by chance stays so and the others don't become it, so the two kinds never meet
    return "".join(reshaped(x, key, f"secret{len(c)}|{before}", lambda s, h=bool(_IS_HEX(x)): bool(_IS_HEX(s)) == h) for x, before in _blocks(c))


def _aws(c: str, key: bytes) -> str:
    both = UPPER + DIGITS
    return c[:4] + reshaped(c[4:], key, "aws", alphabets=dict.fromkeys(both, both))


_LISTED: dict[str, str] = {n: k for k, names in NAMES.items() for n in names}


def _script(word: str) -> str:
    return "cyrillic" if "А" <= word[0] <= "Я" or word[0] == "Ё" else "greek" if "Α" <= word[0] <= "Ω" else "latin"


def _gender(word: str, titled: str) -> str:
    """Of a first name: the title's, else that of its list, else by its ending."""
    return titled or _LISTED.get(word, "")[:1] or ("f" if word[-1] in "aаяα" else "m")


def _written(word: str, role: str, key: bytes, salt: int) -> str:
    """A name of the word's script from syllables, with an ending of its role (f, m or s)."""
    script = _script(word)
    onsets, vowels, codas = SYLLABLES[script]
    n = 0
    while True:
        x = int.from_bytes(hashlib.blake2b(f"{role}|{word}|{salt}|{n}".encode("utf-8", "replace"), key=key, digest_size=16).digest(), "big")
        out = ""
        for k in range(4):
            x, o = divmod(x, len(onsets))
            x, v = divmod(x, len(vowels))
            x, c = divmod(x, len(codas))
            out += onsets[o] + (vowels[v] + codas[c] if k < 3 else "")
        out = (out + ENDINGS[script][role][x % len(ENDINGS[script][role])]).capitalize()
        if out != word and out not in _LISTED:
            return out
        n += 1


def _name(c: str, key: bytes, salt: int = 0) -> str:
    """c: role (f, m: a first name of that gender; s: a surname), a colon and the name."""
    role, _, word = c.partition(":")
    listed = NAMES.get(_LISTED.get(word, ""), []) if role != "s" and _LISTED.get(word, "")[:1] == role else []
    if listed:
        order = sorted(listed, key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
        return order[(order.index(word) + 1) % len(order)]
    return _written(word, role, key, salt)


_ALNUM = re.compile(r"[^0-9A-Za-z]")
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_PART = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][a-zß-öø-ÿа-яёά-ώ'’]+"
_PROPER = rf"{_PART}(?:-{_PART})*"
_FIRST = "|".join(sorted(_LISTED, key=lambda n: (-len(n), n)))
_TITLED = {t: g for g, ts in TITLES.items() for t in ts}

#: (type, pattern with the entity in group "e" or whole, check, canonical form, surrogate, how the surrogate is written)
_TYPES: list[tuple] = [
    ("email", r"(?<![\w.+%'-])[^\W_][\w.+%'-]*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])", None, str.lower, _email, None),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b", lambda s: 15 <= len(x := _ALNUM.sub("", s)) <= 34 and _iban_ok(x), lambda s: _ALNUM.sub("", s), _iban, _in_format),
    ("aws_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", None, str, _aws, None),
    (
        "secret",
        r"(?i:\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?)(?P<secret_e>(?=[^\s\"',;]*\d)[A-Za-z0-9+/_.~!#$%^&*-]{6,})",
        None,
        str,
        _secret,
        None,
    ),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", lambda s: all(int(x) < 256 for x in s.split(".")), lambda s: ".".join(str(int(x)) for x in s.split(".")), _ip, None),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", None, lambda s: _ALNUM.sub("", s), lambda c, k: reshaped(c, k, "ssn"), _in_format),
    ("card", r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w])", lambda s: luhn(_ALNUM.sub("", s)), lambda s: _ALNUM.sub("", s), _card, _in_format),
    (
        "phone",
        r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])",
        lambda s: 8 <= sum(c.isdigit() for c in s) <= 15,
        lambda s: d if len(d := _ALNUM.sub("", s)) != 10 else "1" + d,
        _phone,
        lambda found, c: _in_format(found, c[-sum(x.isdigit() for x in found) :]),
    ),
]
_ALL = re.compile("|".join(f"(?P<{n}>{p})" for n, p, *_ in _TYPES))
_BY_NAME = {n: rest for n, *rest in _TYPES}
#: A text without any of these has none of the above.
_MAYBE = re.compile(r"[0-9@]|A[KS]IA")
_CAPITAL = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω"
#: A capitalised word before another: a person is looked for where the first is a title or a listed first name.
_PAIR = re.compile(rf"([{_CAPITAL}](?<![^\W_].)[^\W\d_]*)[\w'’-]*\.? (?=[{_CAPITAL}])")
_KNOWN = frozenset([*_LISTED, *_TITLED])
_PERSON = re.compile(rf"(?:(?P<title>{_TITLE})\b\.? (?P<titled>{_PROPER}(?: {_PROPER}){{0,2}})|(?P<plain>(?:{_FIRST})(?:-{_PART})*(?: [{_CAPITAL}]\.)? {_PROPER}))(?![^\W_])")
_INITIAL = re.compile(r"[^\W\d_]\.")


class Find(NamedTuple):
    kind: str
    start: int
    end: int
    canonical: str  # of a name: role, colon, name


def _people(m: re.Match) -> list[Find]:
    """The parts of a person's name; with a title a lone name is a surname."""
    group = "titled" if m["titled"] else "plain"
    words = [(w.start() + m.start(group), w[0]) for w in re.finditer(r"\S+", m[group])]
    gender = _TITLED[m["title"]] if m["title"] else ""
    out = []
    for k, (at, word) in enumerate(words):
        if _INITIAL.fullmatch(word):
            continue
        for part in re.finditer(r"[^-]+", word):
            role = "s" if k == len(words) - 1 else _gender(part[0], gender)
            out.append(Find("person", at + part.start(), at + part.end(), f"{role}:{part[0]}"))
    return out


@lru_cache(maxsize=100_000)
def surrogate(kind: str, canonical: str, key: bytes, salt: int = 0) -> str:
    return _name(canonical, key, salt) if kind == "person" else _BY_NAME[kind][3](canonical, key)


def people(text: str) -> list[Find]:
    """The parts of the names of persons that a title or a listed first name tells."""
    out, end = [], 0
    for m in _PAIR.finditer(text):
        if m[1] in _KNOWN and m.start() >= end and (p := _PERSON.match(text, m.start())):
            out += _people(p)
            end = p.end()
    return out


def entities(text: str | None) -> list[Find]:
    """The entities of a text in order; a person's name is one for each part, and further mentions of the parts are found, too."""
    if not text:
        return []
    at, out = 0, []
    while _MAYBE.search(text, at) and (m := _ALL.search(text, at)):
        kind = next(n for n in _BY_NAME if m[n] is not None)
        check, canonical = _BY_NAME[kind][1], _BY_NAME[kind][2]
        group = f"{kind}_e" if kind == "secret" else kind
        if check is None or check(m[group]):
            out.append(Find(kind, m.start(group), m.end(group), canonical(m[group])))
            at = m.end()
        else:
            # another pattern may still fit what this one took
            at = m.start() + 1
            while at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
                at += 1
    found = people(text)
    if found:
        # the parts of one name have one role within a text, that of their first mention
        roles: dict[str, str] = {}
        for f in found:
            roles.setdefault(f.canonical[2:], f.canonical)
        taken = iter([*out, Find("", len(text) + 1, len(text) + 1, "")])
        following = next(taken)
        for m in re.finditer(_PART, text):
            while following.end <= m.start():
                following = next(taken)
            if m[0] in roles and m.end() <= following.start and not text[m.start() - 1 : m.start()].isalnum() and not text[m.end() : m.end() + 1].isalnum():
                out.append(Find("person", m.start(), m.end(), roles[m[0]]))
        out.sort(key=lambda f: f.start)
    return out


def replaced(text: str | None, key: bytes = KEY, salts: dict[str, int] | None = None) -> tuple[str | None, dict[str, int]]:
    """The text with surrogates, and the number of entities by type. salts: of names whose surrogates would meet."""
    counts: dict[str, int] = {}
    if text is None:
        return None, counts
    out, at = [], 0
    for kind, start, end, canonical in entities(text):
        new = surrogate(kind, canonical, key, (salts or {}).get(canonical, 0))
        write = None if kind == "person" else _BY_NAME[kind][4]
        out += [text[at:start], write(text[start:end], new) if write else new]
        at = end
        counts[kind] = counts.get(kind, 0) + 1
    return ("".join(out) + text[at:] if out else text), counts


def name_salts(documents: DataFrame, key: bytes = KEY) -> dict[str, int]:
    """Salts that keep the surrogates of all names of the documents apart; empty as long as no two digests meet.

    Only names that meet another's surrogate come to the driver: of n distinct names about
    n * n / 2**38, a few hundred for ten million.
    """
    spark = documents.sparkSession

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            names = {f.canonical for t in s.column(0).to_pylist() if t for f in people(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], names=["canonical"])

    names = Written(documents.select("text").mapInArrow(found, "canonical string").distinct(), "names")
    salts: dict[str, int] = {}
    while True:
        sent = spark.sparkContext.broadcast(dict(salts))

        def named(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                each = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([surrogate("person", c, key, sent.value.get(c, 0)) for c in each], pa.string())], names=["canonical", "surrogate"])

        # the first of the names that share a surrogate keeps it
        rank = F.row_number().over(Window.partitionBy("surrogate").orderBy("canonical"))
        met = names.df.mapInArrow(named, "canonical string, surrogate string").withColumn("rank", rank).where("rank > 1").select("canonical").collect()
        if not met:
            names.drop()
            return salts
        for r in met:
            salts[r["canonical"]] = salts.get(r["canonical"], 0) + 1


def pseudonymised(documents: DataFrame, key: bytes = KEY, counts: bool = True) -> DataFrame:
    """The documents with surrogates in text and, with counts, two more columns: n_entities and entity_types."""
    more = ["n_entities", "entity_types"] if counts else []
    names = [c for c in documents.columns if c not in more]
    extra = [StructField("n_entities", LongType()), StructField("entity_types", MapType(StringType(), LongType()))] if counts else []
    schema = StructType([documents.schema[n] for n in names] + extra)
    sent = documents.sparkSession.sparkContext.broadcast(name_salts(documents, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            got = [replaced(t, key, sent.value) for t in s.column("text").to_pylist()]
            cols = [pa.array([t for t, _ in got], s.schema.field(n).type) if n == "text" else s.column(n) for n in names]
            if counts:
                cols += [pa.array([sum(c.values()) for _, c in got], pa.int64()), pa.array([sorted(c.items()) for _, c in got], pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *more])

    return documents.select(*names).mapInArrow(run, schema)


def entity_table(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, kind, canonical, surrogate), one row for each entity found."""
    sent = documents.sparkSession.sparkContext.broadcast(name_salts(documents, key))
    ids = documents.schema["doc_id"]
    kind = to_arrow_type(ids.dataType)
    schema = StructType([ids, *(StructField(n, StringType()) for n in ("kind", "canonical", "surrogate"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            rows = [(i, f.kind, f.canonical, surrogate(f.kind, f.canonical, key, sent.value.get(f.canonical, 0))) for i, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True) for f in entities(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "kind", "canonical", "surrogate"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity, and entities with more than one surrogate: none if all is well."""
    pairs = found.select("kind", "canonical", "surrogate").distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("surrogate").alias("value"), F.lit("shared").alias("fault"))
    torn = pairs.groupBy("kind", "canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("canonical").alias("value"), F.lit("torn").alias("fault"))
    return shared.union(torn)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", F.to_json("entity_types").alias("entity_types"))
