"""Surrogates for personal data and secrets.

Detected entities get keyed surrogates of the same type and form: letters stay letters of their script and case, digits
digits, separators stay, a card number that passes the Luhn test still does, a given name keeps its gender (known from the
title before it) and script. A surrogate depends on the key and the entity's normal form alone, so all its mentions get the
same one (coreference): notations of a number that differ in separators or in a leading +1 have one normal form (other
country codes stay part of it), and names found after a title are looked for in the rest of their document, as whole words
in the same letters and case. A given name has one gender in the corpus: that of its titles, or none if they differ.

Distinctness is checked over the corpus, in rounds: the first takes all distinct entities, the later ones those that lost.
Where entities share a surrogate, the smallest keeps it; the others, and those whose surrogate is some entity's real value, try
their next one, which must not be taken either. Later attempts draw from larger spaces: from ``GROW_FROM`` on e-mails, secrets
and names grow by a character an attempt and IPv4 addresses leave 10/8; from ``GROW_ALL`` on every kind grows by a digit an
attempt, which gives up the exact form where a form has fewer values than the corpus has entities. So the rounds end at any
number of entities. Only entities that moved on are looked up when texts are rewritten: few, and broadcast only if counted to
be few; else each document gets its own by a join.

The key is a required argument. ``session_key`` takes it from the setting ``spark.treeflow.pii.key``; without the setting it is
random, one an application, so that nobody can rebuild the mapping and surrogates agree within the application only.

Defined results: null stays null, empty stays empty; overlapping detections are resolved in favour of the earlier and
longer, by the order of ``DETECTORS``; repeated rows get equal texts; other columns pass through (``n_chars``, if present,
follows the text); an input column named like one of the report is replaced by it; a null id is an id like others; an empty
table gives no rows. Detection takes time in proportion to the text and its entities, whose spans are kept in a sorted list.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import secrets
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import checked_broadcast, free_name, map_rows, materialise, rows_of, small, to_arrow

KEY_SETTING = "spark.treeflow.pii.key"
GROW_FROM, GROW_ALL = 4, 24
#: Bytes of entities up to which those that moved on are sent to all tasks.
SENT_BYTES = 8 << 20
ENTITY = "kind string, norm string"

# Titles before names, with the gender they tell; key words before secrets.
TITLES = {
    "m": "Mr Mister Herr Hr Señor Sr Don Monsieur Sir Lord г-н господин κ κύριος",
    "f": "Mrs Ms Miss Frau Fr Señora Señorita Sra Srta Doña Madame Mme Mademoiselle Mlle Lady г-жа госпожа κα κυρία",
    "x": "Dr Prof Professor Mx",
}
SECRET_WORDS = "password passwd passphrase pwd secret token api_key api-key apikey access_key auth_token private_key"

_GENDER = {t.lower(): g for g, all_of in TITLES.items() for t in all_of.split()}
_TITLE = "|".join(sorted((re.escape(t) for all_of in TITLES.values() for t in all_of.split()), key=len, reverse=True))
_NAME = r"[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]+(?:['’-][^\W\d_]+)*"
NAMES = re.compile(rf"(?P<title>{_TITLE})(?P<dot>\.?[  ])(?P<names>{_NAME}(?: {_NAME}){{0,2}})")
NUMBERS = re.compile(
    r"(?P<ipv4>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<card>(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w))"
)
DIGIT = re.compile("[0-9]")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![\w:])")
NAME_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)")
NAME_PART = re.compile(r"[^\W\d_]+")
ACCESS_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
SECRET_LEFT = re.compile(rf"(?:{'|'.join(SECRET_WORDS.split())})[\"']?\s*$", re.IGNORECASE)
SECRET_RIGHT = re.compile(r"[=:]\s*[\"']?([^\s\"',;]{6,})")
LOCAL = re.compile(r"[\w.+%-]+$")
DOMAIN = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")
SEPARATORS = re.compile(r"[^0-9A-Za-z]")

Span = tuple[int, int, str, str]
_OWN_KEYS: dict[str, bytes] = {}


def _emails(text: str) -> list[Span]:
    out, at = [], text.find("@")
    while at >= 0:
        right = DOMAIN.match(text, at)
        left = LOCAL.search(text[max(0, at - 64) : at]) if right else None
        if left:
            start = at - len(left[0].lstrip("."))
            if start < at:
                out.append((start, right.end(), "email", text[start : right.end()].lower()))
        at = text.find("@", at + 1)
    return out


def _secrets(text: str) -> list[Span]:
    out = []
    for mark in "=:":
        at = text.find(mark)
        while at >= 0:
            if SECRET_LEFT.search(text, max(0, at - 24), at) and (m := SECRET_RIGHT.match(text, at)):
                value = m[1].rstrip(".)]}")
                if len(value) >= 6:
                    out.append((m.start(1), m.start(1) + len(value), "secret", value))
            at = text.find(mark, at + 1)
    return out


def _access_keys(text: str) -> list[Span]:
    return [(m.start(), m.end(), "access_key", m[0]) for m in ACCESS_KEY.finditer(text)] if "AKIA" in text or "ASIA" in text else []


def _numbers(text: str) -> list[Span]:
    out = []
    for m in NUMBERS.finditer(text) if DIGIT.search(text) else ():
        kind = m.lastgroup
        if kind == "ipv4" and any(int(x) > 255 for x in m[0].split(".")):
            continue
        norm = m[0] if kind == "ipv4" else SEPARATORS.sub("", m[0])
        if kind == "phone" and m[0].startswith("+1") and len(norm) == 11:
            norm = norm[1:]
        out.append((m.start(), m.end(), kind, norm))
    return out


def _ipv6(text: str) -> list[Span]:
    out = []
    for m in IPV6.finditer(text) if ":" in text and DIGIT.search(text) else ():
        try:
            out.append((m.start(), m.end(), "ipv6", ipaddress.IPv6Address(m[0]).compressed))
        except ValueError:
            pass
    return out


def _names(text: str) -> list[Span]:
    out = []
    for m in NAMES.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        gender, at = _GENDER[m["title"].lower()], m.start("names")
        parts = m["names"].split(" ")
        for i, p in enumerate(parts):
            p = p[:-2] if p.endswith(("'s", "’s")) else p
            kind = "surname" if i == len(parts) - 1 else f"given_{gender}"
            out.append((at, at + len(p), kind, p.casefold()))
            at += len(parts[i]) + 1
    return out


def _again(text: str, names: list[Span]) -> list[Span]:
    """Every mention of the names found, whole words or parts of words with hyphens or apostrophes; a word of several kinds has
    that of its first mention. One pass over the text, however many names there are."""
    known: dict[str, tuple[str, str]] = {}
    for a, b, kind, norm in names:
        known.setdefault(text[a:b], (kind, norm))
    out = []
    for m in NAME_WORD.finditer(text):
        if m[0] in known:
            out.append((m.start(), m.end(), *known[m[0]]))
        elif not m[0].isalpha():
            out += [(p.start(), p.end(), *known[p[0]]) for p in NAME_PART.finditer(text, m.start(), m.end()) if p[0] in known]
    return out


DETECTORS = (_secrets, _emails, _access_keys, _numbers, _ipv6, _names)


def detect(text: str | None) -> list[Span]:
    """``(start, end, kind, normal form)``, without overlaps, in text order."""
    if not text:
        return []
    found = [(s, i, -e, e, kind, norm) for i, f in enumerate(DETECTORS) for s, e, kind, norm in f(text)]
    if names := [(s, e, kind, norm) for s, i, _, e, kind, norm in found if DETECTORS[i] is _names]:
        found += [(s, len(DETECTORS), -e, e, kind, norm) for s, e, kind, norm in _again(text, names)]
    if len(found) < 2:
        return [(s, e, kind, norm) for s, _, _, e, kind, norm in found]
    out, end = [], 0
    taken: list[Span] = []
    for s, _, _, e, kind, norm in sorted(found, key=lambda x: (x[1], x[0], x[2])):
        i = bisect.bisect(taken, (s, e, kind, norm))
        if (not i or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
            taken.insert(i, (s, e, kind, norm))
    for span in taken:
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


class Stream:
    """Numbers from a keyed hash of (kind, normal form, attempt)."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed, self.key, self.n, self.left = f"{kind}\x00{attempt}\x00{norm}".encode("utf-8", "surrogatepass"), key, 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.blake2b(self.seed + self.n.to_bytes(4, "little"), key=self.key[:64]).digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return x % n

    def pick(self, letters: str) -> str:
        return letters[self.below(len(letters))]


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Consonants and vowels by script, and endings of given names by gender.
SCRIPTS = {
    "LATIN": ("bdfghklmnprstvz", "aeiou", {"m": ("n", "r", "s", "k"), "f": ("a", "ia", "ina"), "x": ("e", "i", "o")}),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", {"m": ("н", "р", "с", "к"), "f": ("а", "ия", "ина"), "x": ("и", "о", "е")}),
    "GREEK": ("βγδζκλμνπρστ", "αεηιο", {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ια"), "x": ("ι", "ω", "ε")}),
}


def _same_classes(text: str, s: Stream, letters: str = _LOWER) -> str:
    return "".join(s.pick(_DIGITS) if c.isdigit() else (s.pick(letters.upper()) if c.isupper() else s.pick(letters)) if c.isalpha() else c for c in text)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _iban_remainder(text: str) -> int:
    """The number that an IBAN stands for, modulo 97: 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The surrogate of a normal form, itself a normal form."""
    s, grow = Stream(key, kind, norm, attempt), max(0, attempt - GROW_FROM + 1)
    out = _formed(kind, norm, s, grow)
    return out + "".join(s.pick(_DIGITS) for _ in range(attempt - GROW_ALL + 1)) if attempt >= GROW_ALL else out


def _formed(kind: str, norm: str, s: Stream, grow: int) -> str:
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        top = labels[-1] if labels[-1] in ("com", "org", "net") else "org"
        return ".".join([_same_classes(local, s) + "".join(s.pick(_LOWER) for _ in range(grow)) + "@" + x if i == 0 else x for i, x in enumerate([*(_same_classes(x, s) for x in labels[:-2]), "example", top])])
    if kind == "ipv4":
        return ".".join(map(str, [s.below(256) if grow else 10, s.below(256), s.below(256), s.below(256)]))
    if kind == "ipv6":  # the prefix for documentation
        return ipaddress.IPv6Address(0x20010DB8 << 96 | s.below(1 << 32) << 64 | s.below(1 << 32) << 32 | s.below(1 << 32)).compressed
    if kind in ("card", "ssn", "phone"):
        keep = {"card": 1, "ssn": 0, "phone": max(0, len(norm) - 10)}[kind]
        out = norm[:keep] + "".join(s.pick(_DIGITS) for _ in norm[keep:])
        if kind == "card" and _luhn(norm) == 0:
            out = out[:-1] + "0"
            out = out[:-1] + str((10 - _luhn(out)) % 10)
        return out
    if kind == "iban":
        out = norm[:2] + "".join(s.pick(_DIGITS) if c.isdigit() else s.pick(_LOWER.upper()) for c in norm[2:])
        if _iban_remainder(norm) == 1:  # a valid one stays valid
            out = out[:2] + f"{98 - _iban_remainder(out[:2] + '00' + out[4:]):02d}" + out[4:]
        return out
    if kind == "access_key":
        return norm[:4] + "".join(s.pick(_LOWER.upper() + _DIGITS) for _ in norm[4:])
    if kind == "secret":
        lower = norm.lower()
        return _same_classes(norm, s, "abcdef" if all(c in "0123456789abcdef" for c in lower) else _LOWER) + "".join(s.pick(_DIGITS) for _ in range(grow))
    script = next((k for k in SCRIPTS if k in unicodedata.name(norm[0], "")), "LATIN")
    consonants, vowels, endings = SCRIPTS[script]
    body = "".join(s.pick(consonants) + s.pick(vowels) for _ in range(min(4, max(2, len(norm) // 2)) + grow))
    if kind == "surname":
        return body + s.pick(consonants)
    ends = endings[kind[-1]]
    return body[:-1] + ends[s.below(len(ends))]


def render(mention: str, kind: str, norm: str, value: str) -> str:
    """``value`` in the notation of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(value)
        extra = sum(c.isalnum() for c in mention) - len(value)
        if kind == "phone" and extra > 0:  # the country code isn't part of the normal form
            left = iter([c for c in mention if c.isalnum()][:extra] + list(value))
        return "".join(next(left, "") if c.isalnum() else c for c in mention) + "".join(left)
    if kind == "email":
        return value.upper() if mention.isupper() else value
    if kind == "surname" or kind.startswith("given"):
        return value.upper() if mention.isupper() and len(mention) > 1 else value[:1].upper() + value[1:]
    return value


def rewrite(text: str | None, attempts: dict[tuple[str, str], int], key: bytes, kinds: dict[tuple[str, str], str] | None = None) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds replaced. ``kinds``: what given names of several genders count as."""
    spans = detect(text)
    if kinds:
        spans = [(s, e, kinds.get((kind, norm), kind), norm) for s, e, kind, norm in spans]
    if not spans:
        return text, []
    out, at = [], 0
    for s, e, kind, norm in spans:
        out += [text[at:s], render(text[s:e], kind, norm, surrogate(kind, norm, attempts.get((kind, norm), 0), key))]
        at = e
    return "".join([*out, text[at:]]), [x[2] for x in spans]


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting, else a random one of this application."""
    stated = spark.conf.get(KEY_SETTING, None)
    return stated.encode() if stated else _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def moved_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``kind, norm, attempt, mentioned`` of the distinct entities that don't use their first surrogate, and of given names
    that are mentioned as another kind than the one decided from all their titles."""
    def each(row):
        yield from {(kind, norm) for _, _, kind, norm in detect(row[0])}

    mentioned = materialise(map_rows(docs.select(F.col(text_col)), lambda: each, ENTITY).distinct(), "pii-mentioned")
    given = mentioned.where(F.col("kind").startswith("given")).groupBy("norm").agg(F.collect_set("kind").alias("all")).where("size(all) > 1")
    known = F.array_remove("all", "given_x")
    given = materialise(given.select("norm", F.when(F.size(known) == 1, F.get(known, 0)).otherwise("given_x").alias("one")), "pii-given")
    if given.isEmpty():
        entities, other = mentioned, None
    else:
        decided = mentioned.join(given.withColumn("g", F.lit(True)), (mentioned["norm"] == given["norm"]) & mentioned["kind"].startswith("given"), "left")
        decided = materialise(decided.select(F.coalesce("one", "kind").alias("kind"), mentioned["norm"], mentioned["kind"].alias("mentioned")), "pii-decided")
        entities, other = materialise(decided.select("kind", "norm").distinct(), "pii-entities"), decided.where("kind <> mentioned")

    def result(old: DataFrame) -> DataFrame:
        out = old.withColumn("mentioned", F.col("kind"))
        if other is not None:
            out = out.unionByName(other.join(old, ["kind", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))))
        return materialise(out, "pii-moved")

    def surrogates():
        return lambda row: ((row[0], row[1], row[2], surrogate(row[0], row[1], row[2], key)),)

    family = F.when(F.col("kind").startswith("given"), F.lit("given")).otherwise(F.col("kind")).alias("family")
    real = entities.select(family, F.col("norm").alias("value")).distinct()
    active, settled, attempt = entities, [], 0
    while True:
        named = map_rows(active.select("kind", "norm", F.lit(attempt)), surrogates, f"{ENTITY}, attempt int, value string").withColumn("family", family)
        named = materialise(named, "pii-surrogates")
        tried = checked_broadcast(named.select("family", "value"))
        bad = [real.join(tried, ["family", "value"], "left_semi")] + [old.select("family", "value").join(tried, ["family", "value"], "left_semi") for old in settled]
        bad = materialise(reduce(DataFrame.unionByName, bad).distinct(), "pii-taken")
        first = named.groupBy("family", "value").agg(F.min(F.struct("kind", "norm")).alias("first"))
        won = named.join(first, ["family", "value"]).where((F.col("kind") == F.col("first.kind")) & (F.col("norm") == F.col("first.norm"))).drop("first")
        won = materialise(won.join(checked_broadcast(bad), ["family", "value"], "left_anti"), "pii-settled")
        settled.append(won)
        active = materialise(active.select("kind", "norm").join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pii-again")
        attempt += 1
        if active.isEmpty():
            return result(reduce(DataFrame.unionByName, settled).where("attempt > 0").select("kind", "norm", "attempt"))


def anonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """The documents with surrogates in their texts; with ``report`` also ``n_replaced`` and ``kinds`` (sorted)."""
    if report:
        docs = docs.drop("n_replaced", "kinds")
    moved = moved_entities(docs, key, text_col)
    columns, spark = docs.columns, docs.sparkSession
    at, chars = columns.index(text_col), columns.index("n_chars") if "n_chars" in columns else -1
    schema = docs.schema
    if report:
        schema = StructType([*schema.fields, StructField("n_replaced", IntegerType()), StructField("kinds", StringType())])
    arrow = to_arrow(spark, schema)
    if small(moved) and (moved.agg(F.sum(F.octet_length("norm"))).first()[0] or 0) <= SENT_BYTES:
        common = [tuple(r) for r in moved.select("mentioned", "norm", "kind", "attempt").collect()]  # counted: at most BROADCAST_ROWS rows and SENT_BYTES
        source, own = docs, False
    else:  # each document gets the attempts of its own entities
        mine, lists_of = free_name(columns, "tf_id"), free_name(columns, "tf_moved")
        mentions = map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), lambda: lambda row: {(row[0], k, n) for _, _, k, n in detect(row[1])}, f"{mine} long, {ENTITY}")
        own_moved = moved.withColumnsRenamed({"kind": "decided", "mentioned": "kind"})
        lists = mentions.join(own_moved, ["kind", "norm"]).groupBy(mine).agg(F.collect_set(F.struct("kind", "norm", "decided", "attempt")).alias(lists_of))
        source = docs.join(lists, F.col(id_col).cast("long").eqNullSafe(F.col(mine)), "left").drop(mine)
        common, own = [], True

    def run(it):
        tables = lambda rows: ({(k, n): a for _, n, k, a in rows}, {(m, n): k for m, n, k, _ in rows if m != k})
        shared = tables(common)
        for batch in it:
            texts, counts, kinds = [], [], []
            extra = batch.column(batch.num_columns - 1).to_pylist() if own else None
            for i, (text,) in enumerate(rows_of(batch.select([at]))):
                attempts, as_kinds = tables([(x["kind"], x["norm"], x["decided"], x["attempt"]) for x in extra[i] or ()]) if own else shared
                text, found = rewrite(text, attempts, key, as_kinds)
                texts.append(text)
                counts.append(len(found))
                kinds.append(",".join(sorted(found)))
            out = [batch.column(i) for i in range(len(columns))]
            out[at] = pa.array(texts, arrow.field(at).type)
            if chars >= 0:
                lengths = [old if text is None else len(text) for text, old in zip(texts, batch.column(chars).to_pylist())]
                out[chars] = pa.array(lengths, arrow.field(chars).type)
            if report:
                out += [pa.array(counts, pa.int32()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(out, schema=arrow)

    return source.mapInArrow(run, schema)
