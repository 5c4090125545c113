"""Personal data: patterns, and information-theoretic sanitisation of the terms that give it away.

Protected entities are the matches of four patterns. How far a term t discloses an entity e is estimated from the
corpus, as in C-sanitisation (Sanchez and Batet): the pointwise mutual information of t and e as a share of e's
information content,

    disclosure = PMI(t, e) / IC(e) = 1 - log(n(t) / n(t, e)) / log(N / n(e)),

with N distinct texts, n(t) of them with the term, n(e) with the entity and n(t, e) with both, anywhere in the text: all
four count distinct texts, so copies of one text neither make evidence nor hide it. A term stands in a text where one
of its words doesn't touch a match of a pattern. Low counts are judged by a bound: n(t, e) / n(t) is taken at the lower
end of its Wilson interval of ``deviations``. A term whose bounded disclosure of some entity reaches ``generalise`` is
replaced by its shape, or taken out if its disclosure reaches ``remove``, wherever it stands. With one deviation, a term
that stands in one text only, beside an entity of that text only, is found from 1,024 distinct texts on.

One pass over the distinct texts counts all words and notes the words of the texts with entities. Words too frequent to
reach ``generalise`` beside any of their texts' entities go before pairs are made, and entities of the same texts are
one, so a text of many entities and words doesn't multiply them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, materialize, slices

#: Kinds of spans, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What goes on with a word once it has begun: marks, and the joiners of scripts that need them.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M") + "\u200c\u200d\ufe0f"
_WORD = re.compile(rf"\w+(?:[{_MARKS}]+\w*)*")
_DIGIT = re.compile(r"[0-9]")
MEMO = 200_000
FILTER_BITS = 1 << 26


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, told from each @ so that a long run of word characters is read once."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
            at = text.find("@", free)
        else:
            free = at + 1  # what stands before a failed @ can't be the local part of a later one
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, sorted; code points, end exclusive."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if max(map(_small, m[0].split("."))) <= 255]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def _small(part: str) -> int:
    """The number that a part spells; parts of any length are told from 255."""
    part = part.lstrip("0")
    return int(part) if part and len(part) <= 3 else 0 if not part else 256


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entity(text: str, span: tuple[int, int, int]) -> int:
    """The entity a span names: letters and digits count, case and separators don't."""
    a, kind, b = span
    value = text[a:b].lower() if kind < 2 else "".join(_DIGIT.findall(text[a:b]))
    h = xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}")
    return h - (1 << 64) if h >> 63 else h


def standing(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-cased word) of the words that don't touch a base span."""
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    for m in _WORD.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            yield m.start(), m.end(), m[0].lower()


def words_of(text: str, base: list[tuple[int, int, int]]) -> set[str]:
    """The distinct lower-cased words that don't touch a base span."""
    return {w for _, _, w in standing(text, base)} if base else {w.lower() for w in set(_WORD.findall(text))}


SURVEY = pa.schema([("term", pa.string()), ("n", pa.int64()), ("h", pa.int64()), ("entities", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many texts of the task a word stands, the empty one in all; (h, entities, words) of texts with entities."""
    counts: dict[str, int] = {}
    for batch in slices(batches):
        found = []
        for h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base = base_spans(text)
            words = words_of(text, base)
            if base:
                found.append((h, list({entity(text, s) for s in base}), [w for w in words if not w.isdigit() and len(w) != 1]))
            words.add("")
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        if found:
            yield _rows([None] * len(found), [None] * len(found), *zip(*found, strict=True))
        if len(counts) > MEMO:
            yield _rows(counts.keys(), counts.values(), *[[None] * len(counts)] * 3)
            counts = {}
    if counts:
        yield _rows(counts.keys(), counts.values(), *[[None] * len(counts)] * 3)


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SURVEY.types, strict=True)], schema=SURVEY)


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, text): each text once, h its hash. Only texts that are repeated are shuffled where their hashes fit a broadcast."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))
    repeated = materialize(keyed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h"))
    return keyed.join(repeated, "h", "left_anti").union(keyed.join(repeated, "h", "left_semi").dropDuplicates(["h"]))


def disclosure(n_docs, n_term, n_entity, n_both):
    """Share of the entity's information content that the term gives away."""
    return 1 - F.log(n_term / n_both) / F.greatest(F.log(n_docs / n_entity), F.lit(1e-9))


def bounded(n_docs, n_term, n_entity, n_both, deviations: float):
    """The disclosure with n_both / n_term at the lower end of its Wilson interval."""
    p, z = n_both / n_term, deviations * deviations / n_term
    low = (p + z / 2 - F.sqrt(z * p * (1 - p) + z * z / 4)) / (1 + z)
    return disclosure(n_docs, 1 / low, n_entity, F.lit(1))


def revealing_terms(docs: DataFrame, text_col: str = "text", deviations: float = 1.0, generalise: float = 0.9) -> DataFrame:
    """(term, disclosure): the terms whose bounded disclosure of some entity reaches ``generalise``."""
    survey = materialize(distinct_texts(docs, text_col).mapInArrow(_survey, "term string, n long, h long, entities array<long>, words array<string>"))
    counts, found = survey.where(F.col("term").isNotNull()), survey.where(F.col("h").isNotNull())
    n_docs = F.lit(counts.where(F.col("term") == "").agg(F.sum("n")).first()[0] or 1)
    mentions = found.select("h", F.explode("entities").alias("entity"))
    texts = mentions.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("h")).alias("a"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("b"))
    entities = texts.groupBy("n_e", "a", "b").agg(F.min("entity").alias("entity")).select("entity", "n_e")  # one of those that share all their texts
    mentions = materialize(mentions.join(entities, "entity"))
    # disclosure >= generalise, so n(t) <= n(t, e) (N / n(e))^(1 - generalise), where n(t, e) <= n(e)
    reach = mentions.groupBy("h").agg(F.max(F.pow("n_e", F.lit(generalise)) * F.pow(n_docs, F.lit(1 - generalise))).alias("reach"))
    words = found.select("h", F.explode("words").alias("term"))
    most = words.join(reach, "h").groupBy("term").agg(F.max("reach").alias("reach"))
    rare = counts.groupBy("term").agg(F.sum("n").alias("n_t")).join(most, "term").where(F.col("n_t") <= F.col("reach") * (1 + 1e-9)).select("term", "n_t")
    both = words.join(rare, "term").join(mentions, "h").groupBy("term", "entity").agg(F.count("*").alias("n"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    found_by = both.where(bounded(n_docs, F.col("n_t"), F.col("n_e"), F.col("n"), deviations) >= generalise)
    return materialize(found_by.groupBy("term").agg(F.max(disclosure(n_docs, F.col("n_t"), F.col("n_e"), F.col("n"))).alias("disclosure")))


def term_spans(text: str, terms: dict[str, float], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of revealing terms that don't touch a base span."""
    if not terms or terms.keys().isdisjoint({w.lower() for w in set(_WORD.findall(text))}):
        return []
    return [(a, 4, b) for a, b, w in standing(text, base) if w in terms]


def shape(word: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitised(text: str, spans: list[tuple[int, int, int]], terms: dict[str, float], remove: float) -> str:
    """The text with base spans replaced by their kind, and terms generalised or taken out."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]" if k < 4 else "" if terms[text[a:b].lower()] >= remove else shape(text[a:b])]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = 0.97, texts: bool = True, round_terms: int = 100_000, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans[, sanitised]) for each row of ``docs``.

    Null text counts as empty. Spans are code points, ends exclusive. Base spans of different kinds may overlap and all
    count; a term never touches a base span. Rows are independent, so repeated rows agree. An empty table gives an
    empty result.
    """
    terms = revealing_terms(docs, text_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if terms.count() > round_terms:
        return _joined(rows, terms, remove, texts)
    shared = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in terms.collect()})  # at most round_terms
    return rows.mapInArrow(_mark(shared, remove, texts), _schema(texts))


def _schema(texts: bool) -> str:
    return "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string" + ", sanitised string" * texts


def _mark(shared, remove: float, texts: bool, also: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for i, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = dict(rest[0] or ()) if also else shared.value
                base = base_spans(text)
                found = term_spans(text, terms, base)
                kinds = [k for _, k, _ in base]
                spans = sorted(base + found)
                row = (i, *(kinds.count(k) for k in range(4)), len(found), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans))
                out.append((*row, sanitised(text, spans, terms, remove)) if texts else row)
            if out:
                kinds_ = [pa.int64()] * 6 + [pa.string()] * (2 + texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_, strict=True)], [f.split()[0] for f in _schema(texts).split(", ")])

    return run


def _filter(terms: DataFrame):
    """A broadcast of FILTER_BITS bits, those at the terms' hashes set."""
    at = terms.select(F.xxhash64("term").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"))
    return terms.sparkSession.sparkContext.broadcast(bitmap(at, "at", FILTER_BITS) or bytes(FILTER_BITS // 8))


def _candidates(shared):
    """(doc_id, key, term): the words of each row that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in slices(batches):
            ids, keys, words = [], [], []
            for i, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in words_of(text, []):
                    h = xxhash.xxh64_intdigest(w, 42) & (FILTER_BITS - 1)  # Spark's xxhash64
                    if bits[h >> 3] >> (h & 7) & 1:
                        ids.append(i), keys.append(key), words.append(w)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["doc_id", "_key", "term"])

    return run


def _joined(rows: DataFrame, terms: DataFrame, remove: float, texts: bool) -> DataFrame:
    """For more terms than one broadcast holds: each document takes its own terms by a join on the words that pass a filter."""
    keyed = rows.select("doc_id", F.xxhash64("text").alias("_key"), "text")
    words = keyed.mapInArrow(_candidates(_filter(terms)), "doc_id long, _key long, term string")
    own = words.join(terms, "term").groupBy("doc_id", "_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("terms"))
    own = own.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"), "terms")
    joined = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    return joined.select("doc_id", "text", "terms").mapInArrow(_mark(None, remove, texts, also=True), _schema(texts))
