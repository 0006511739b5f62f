"""One consistent form for texts that look the same.

A mapping for widths, spaces, characters of no width and look-alike letters is computed once,
checked for conflicts, and compiled with Unicode composition into a transducer over grapheme
clusters (a base and all that attaches to it, longest match). One pass over a text rewrites the
clusters that need it; a cluster's output is computed once and kept.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sonarloom.functions.text import ascii_only
from sonarloom.operators.skew import for_parts, hot_keys, in_parts, skew_join
from sonarloom.session import cut

# Letters and the Latin letters they look like. Of the public Unicode confusables that lead from one Cyrillic
# or Greek letter to one Latin letter, those are left out that readers tell apart: U+0433 (r), U+042C (b), U+0461 (w),
# U+04BD (e), U+A647 (i), U+03B3 (y), U+03C3 (o), U+03F1 (p), U+03D2 (Y), U+037A (i).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮҺԌԚԜасеһіјорԛѕухԝү\u0501\u04cf\u04c0\u0475\u0474", "ABESIJKMHOPCTYXYhGQWacehijopqsyxwydlIvV"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιρνυϳϲ\u03f9\u037f\u03dc\u03fa", "ABEZHIKMNOPTYXoaipvujcCJFM"))
# Format characters that are seen, and characters without width outside category Cf.
SEEN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"
NO_WIDTH = "͏឴឵᠋᠌᠍᠏" + "".join(map(chr, range(0xFE00, 0xFE10))) + "".join(map(chr, range(0xE0100, 0xE01F0))) + "\u115f\u1160\u3164\uffa0"


def build_mapping() -> dict[str, str]:
    """Character -> its consistent form ('' for characters of no width). Raises on a conflict."""
    out: dict[str, str] = {}

    def rule(ch: str, to: str) -> None:
        if out.setdefault(ch, to) != to:
            raise ValueError(f"two rules for U+{ord(ch):04X}: {out[ch]!r} and {to!r}")

    for ch in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(ch)
        width = unicodedata.decomposition(ch).split(" ")
        if ch in NO_WIDTH:
            rule(ch, "")
        elif kind == "Zs":
            if ch != " ":
                rule(ch, " ")
        elif kind == "Cf" and ch not in SEEN_FORMAT:
            rule(ch, "")
        elif width[0] in ("<wide>", "<narrow>"):
            rule(ch, "".join(chr(int(x, 16)) for x in width[1:]))
    for table in (CYRILLIC, GREEK):
        for ch, to in table.items():
            rule(ch, to)
    for ch, to in out.items():  # outputs are final: no chains, nothing that composition would change again
        if any(x in out for x in to) and "".join(out.get(x, x) for x in to) != to:
            out[ch] = "".join(out.get(x, x) for x in to)
    for ch, to in out.items():
        if any(out.get(x, x) != x for x in to):
            raise ValueError(f"U+{ord(ch):04X} maps to {to!r}, which maps on")
    return out


MAPPING = build_mapping()


def _ranges(chars: set[str]) -> str:
    """A character class body for the given characters."""
    points, parts = sorted(map(ord, chars)), []
    while points:
        n = 1
        while n < len(points) and points[n] == points[0] + n:
            n += 1
        a, b = points[0], points[n - 1]
        parts.append(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}")
        points = points[n:]
    return "".join(parts)


def _attaching() -> set[str]:
    """What joins the cluster before it: marks, characters of no width, and jamo vowels and finals."""
    marks = {c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M"}
    narrow = {c for c in map(chr, range(0xFF00, 0xFFF0)) if len(MAPPING.get(c, "")) == 1 and (unicodedata.category(MAPPING[c])[0] == "M" or "ᅠ" <= MAPPING[c] <= "ᇿ")}
    return marks | narrow | {c for c, to in MAPPING.items() if not to} | set(map(chr, range(0x1160, 0x1200)))


_ATTACH = frozenset(_attaching())
_STARTS = {c for c, to in MAPPING.items() if to} | {
    c for c in map(chr, range(0x80, 0x10000)) if not 0xAC00 <= ord(c) <= 0xD7A3 and (unicodedata.normalize("NFC", c) != c or any(x in MAPPING for x in unicodedata.normalize("NFD", c)))
}
#: Runs of characters that may change or attach; all beyond the BMP may, which keeps the compiled set a plain bitmap.
_RUN = re.compile(f"[{_ranges({c for c in _ATTACH | _STARTS if c < chr(0x10000)})}\U00010000-\U0010ffff]+")


class _Clusters(dict):
    """Cluster run -> output, computed on first sight; cleared when large, so memory stays bounded."""

    def __missing__(self, run: str) -> str:
        if len(self) > 200_000:
            self.clear()
        # Taking a base apart first lets an accented look-alike reach the accented Latin letter.
        apart = "".join(MAPPING.get(x, x) for ch in run for x in (ch if ch in MAPPING else unicodedata.normalize("NFD", ch)))
        self[run] = out = unicodedata.normalize("NFC", apart)
        return out


_seen = _Clusters()


def consistent(text: str) -> str:
    """The consistent form. Idempotent; case, digits, accents, words and line ends are kept."""
    if text.isascii():
        return text
    out, done = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        if start > done and text[start] in _ATTACH:
            start -= 1  # the base it attaches to
        out += text[done:start], _seen[text[start:end]]
        done = end
    return "".join(out) + text[done:] if out else text


@F.arrow_udf(StringType())
def _form(text: pa.Array) -> pa.Array:
    return pa.array([x if x is None else consistent(x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _form_md5(text: pa.Array) -> pa.Array:
    return pa.array([x if x is None else hashlib.md5(consistent(x).encode("utf-8", "surrogatepass")).hexdigest() for x in text.to_pylist()], pa.string())


def consistent_form(text: Column) -> Column:
    """The consistent form of a text column. ASCII texts are theirs already and stay in the JVM. Null stays null."""
    return F.coalesce(_form(F.when(~ascii_only(text), text)), text)


def form_digest(text: Column) -> Column:
    """md5 of the consistent form, without moving the form itself."""
    return F.coalesce(_form_md5(F.when(~ascii_only(text), text)), F.md5(text))


def same_reading(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts that read the same: (classes, pairs).

    classes has one row per document: id, form, stored (digests of its form and its stored text).
    pairs: a, b (smaller id first), documents that read the same though stored differently. Copies
    of one stored text are not paired with one another. Null texts read like nothing, empty
    ones like each other. Stored texts are paired first, one row for any number of copies; only
    those links are expanded to documents, and copies without number are spread over parts.
    """
    text = F.col(text_column)
    classes = cut(docs.filter(text.isNotNull()).select(F.col(id_column).alias("id"), F.unhex(form_digest(text)).alias("form"), F.unhex(F.md5(text)).alias("stored")), "forms")
    stored = cut(classes.groupBy("form", "stored").agg(F.count("*").alias("n")), "stored-texts")
    mixed = stored.groupBy("form").agg(F.count("*").alias("k")).filter("k > 1").select("form")
    variants = stored.join(mixed, "form")
    # Forms with very many variants are spread as well.
    crowded = hot_keys(cut(variants.groupBy("form").agg(F.count("*").alias("n")), "variants"), ["form"])
    links = skew_join(variants.select("form", F.col("stored").alias("sa")), variants.select("form", F.col("stored").alias("sb")), crowded, ["form"], ["sa"]).filter(F.col("sa") != F.col("sb"))
    hot = hot_keys(stored, ["stored"])
    a, b = classes.select(F.col("stored").alias("sa"), F.col("id").alias("a")), classes.select(F.col("stored").alias("sb"), F.col("id").alias("b"))
    one = skew_join(a, links.select("sa", "sb"), hot.withColumnRenamed("stored", "sa"), ["sa"], ["a"])
    # Both sides may hold many copies here: the left is spread by its own hash, and meets every part of the right.
    right = hot.withColumnRenamed("stored", "sb")
    pairs = for_parts(one, right, ["sb"]).join(in_parts(b, right, ["sb"], ["b"]), ["sb", "_part"])
    return classes, pairs.filter(F.col("a") < F.col("b")).select("a", "b")


def form_sql(text: str) -> str:
    """The consistent form in DuckDB's SQL: one translation of characters, then composition.

    Derived from the mapping, for characters whose own consistent form is one character or none; the
    few precomposed ones that come apart into more are replaced one by one.
    """
    change = {c: consistent(c) for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF and c.isprintable() | (c in MAPPING) and consistent(c) != unicodedata.normalize("NFC", c)}
    longer = {c: to for c, to in change.items() if len(to) > 1}
    kept = [c for c, to in change.items() if len(to) == 1]
    gone = [c for c, to in change.items() if not to]
    out = text
    for c, to in longer.items():
        out = f"replace({out}, chr({ord(c)}), {'||'.join(f'chr({ord(x)})' for x in to)})"
    quoted = "".join(kept + gone), "".join(change[c] for c in kept).replace("'", "''")
    return f"nfc_normalize(translate({out}, '{quoted[0]}', '{quoted[1]}'))"
