"""Personal data by pattern, and terms that give it away by information theory.

Four patterns find the protected entities (e-mail, IP, card, phone). Over the whole corpus, a term
that shares texts with an entity discloses it as far as knowing the term makes the entity expected:
with document counts n(t, e), n(t), n(e) and N, disclosure = PMI(t; e) / IC(e), where
PMI = log(N n(t,e) / n(t) n(e)) and IC(e) = log(N / n(e)). It is 1 for a term that is found only with
the entity and about 0 for a common word. Terms above the threshold, met with the entity in several
different contexts (words around the entity's places in a text), are spans too, wherever they stand in
any text: removed, or generalised to the kind of entity they disclose. A text is one context, however
often it names the entity, and copies are one together: the words of a single text tell nothing.

Scale: a first pass over the texts leaves the entities and the terms of the texts that hold one in
the shared folder. An entity without enough contexts goes before its terms are looked at, a term goes
when no entity is frequent enough for it. Terms of the same texts have the same counts with every
entity, and so have entities of the same kind whose contexts lie in the same texts: both are counted
as classes, one of each standing for all, so a text of n entities and m terms gives as many pairs as
it has classes of each, not n times m. A text with many classes of entities is dealt in chunks. Terms'
document counts come from a second pass over all texts and their places from a third, both thinned by
a bitmap of bounded size; a task counts its terms together before the counts are shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, id_and_text, in_bitmap, join_counted, materialise, row_numbers, rows, settle, slices, split, tables_now, tidied, unpack, whole_rows
from .spans import Span, digest, joined

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Words on each side of an entity that make a context; None: all of the text.
WINDOW = 6
#: Texts with different contexts that an entity, and each term that discloses it, must be met in; 1 asks for none: then copies count too.
MIN_CONTEXTS = 3
#: Share of an entity's information content that a term must give away.
DISCLOSURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?()[]{}<>\"'*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches without overlap. Each @ is tried once with the whole run before it, so long runs cost no more than their length."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: bytes) -> list[Span]:
    """Base spans by kind as listed, then start."""
    at, plus = b"@" in text, b"+" in text
    digits = len(text) - len(text.translate(None, b"0123456789"))
    if not at and digits < 4:
        return []
    decoded = text.decode("utf-8", "replace")
    out = emails(decoded) if at else []
    if digits >= 4:
        for m in _IP.finditer(decoded):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    if digits >= 16:
        for m in _CARD.finditer(decoded):
            number = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(number) <= 19 and luhn(number):
                out.append(("card", m.start(), m.end()))
    if plus and digits >= 8:
        for m in _PHONE.finditer(decoded):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _term(word: str) -> str:
    return word.strip(_EDGES).lower()


def _words(text: str, spans: list[Span]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether no span meets it) of each word."""
    covered = sorted((a, b) for _, a, b in spans)
    k = reach = 0
    for m in _TERM.finditer(text):
        x, y = m.span()
        while k < len(covered) and covered[k][0] < y:
            reach = max(reach, covered[k][1])
            k += 1
        yield x, y, x >= reach


def free_words(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end), marks at the edges aside, of the words that no span meets."""
    for x, y, free in _words(text, spans):
        if free:
            word = text[x:y]
            yield _term(word), x + len(word) - len(word.lstrip(_EDGES)), y - len(word) + len(word.rstrip(_EDGES))


def entity_contexts(text: str, spans: list[Span], window: int | None) -> dict[tuple[str, str], set[int]]:
    """The contexts of each (kind, entity): checksums of the terms within the window around its places that no span covers; without a window, of the whole text's."""
    out: dict[tuple[str, str], set[int]] = {}
    words = list(_words(text, spans))
    starts = [x for x, _, _ in words]

    def checksum(around: list[tuple[int, int, bool]]) -> int:
        terms = [_term(text[x:y]) for x, y, free in around if free]
        return zlib.crc32(" ".join(sorted(terms)).encode("utf-8", "replace"))

    whole = checksum(words) if window is None else 0
    for kind, a, b in spans:
        context = whole
        if window is not None:
            first = bisect.bisect_left(starts, a)
            after = bisect.bisect_left(starts, b)
            context = checksum(words[max(0, first - window) : first] + words[after : after + window])
        out.setdefault((kind, text[a:b].lower()), set()).add(context)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ENTITY = pa.struct([("kind", pa.string()), ("entity", pa.string()), ("context", pa.int64())])
_PLACE = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_HOLDING = "row bigint, entities array<struct<kind:string,entity:string,context:bigint>>, terms array<string>"
_FOUND = (
    "row bigint, id bigint, sha string, base array<struct<kind:string,start:bigint,end:bigint>>, "
    "places array<struct<term:string,start:bigint,end:bigint>>"
)


def _scan(window: int | None):
    """A number, the entities with their context, and all terms, of each text that holds an entity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row_numbers()
        for _, texts in rows(batches):
            entities, terms = [], []
            for text in texts:
                base = base_spans(text)
                if base:
                    decoded = text.decode("utf-8", "replace")
                    found = entity_contexts(decoded, base, window)
                    entities.append([{"kind": k, "entity": e, "context": zlib.crc32(str(sorted(c)).encode())} for (k, e), c in found.items()])
                    terms.append(sorted({t for t, _, _ in free_words(decoded, base) if t}))
            arrays = [pa.array(number(len(terms)), pa.int64()), pa.array(entities, pa.list_(_ENTITY)), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "entities", "terms"])

    return scan


def _marks(marked: bytes | None):
    """Base spans of each text, and the places of the terms whose place in the bitmap is set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row_numbers()
        bits = unpack(marked) if marked else None
        for ids, texts in rows(batches):
            base = [base_spans(t) for t in texts]
            places: list[list[dict]] = []
            for text, spans in zip(texts, base):
                terms = _set_terms(text, bits) if bits is not None else None
                words = free_words(text.decode("utf-8", "replace"), spans) if terms else ()
                places.append([{"term": t, "start": a, "end": b} for t, a, b in words if t in terms])
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in b] for b in base]
            shas = [hashlib.sha256(t).hexdigest() if p else None for t, p in zip(texts, places)]  # asked for where there are places
            arrays = [pa.array(number(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(places, pa.list_(_PLACE))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "sha", "base", "places"])

    return mark


def _set_terms(text: bytes, bits: np.ndarray) -> set[str]:
    """The terms of a text whose place is set."""
    terms = {_term(w.decode("utf-8", "replace")) for w in set(text.split())}
    return {t for t in terms if t and bits[zlib.crc32(t.encode("utf-8", "replace")) % len(bits)]}


#: Distinct terms that a task counts together before it sends them on.
_FOLD_TERMS = 100_000


def _term_counts(marked: bytes):
    """How many texts hold each term whose place is set, counted together for many texts."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = unpack(marked), Counter()
        for _, texts in rows(batches):
            for text in texts:
                counts.update(_set_terms(text, bits))
            if len(counts) > _FOLD_TERMS:
                yield sent(counts)
                counts = Counter()
        yield sent(counts)

    return count


def _term_bitmap(df: DataFrame) -> bytes:
    return bitmap(df.select(F.expr("crc32(encode(term, 'utf-8'))").alias("crc")), "crc")


#: Classes of entities of one text that one task pairs with the text's classes of terms.
_CHUNK = 256


def _set_digest(*columns: str) -> list[Column]:
    """What tells sets of rows apart, whatever their order: their number and 128 bits of hashes."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("y")]


def _entity_classes(every: DataFrame, min_contexts: int) -> DataFrame:
    """One entity of each class of those with enough contexts, and n_entity: entities of a class have the same kind, and for each context of one the other has one in the same texts."""
    key = ["kind", "entity"]
    by_context = every.groupBy(*key, "context").agg(*_set_digest("row"))
    of_entity = by_context.groupBy(*key).agg(*_set_digest("n", "x", "y"), F.sum("n").alias("n_entity")).where(F.col("n") >= min_contexts)
    return materialise(of_entity.groupBy("kind", "n", "x", "y").agg(F.min_by(F.struct("entity", "n_entity"), "entity").alias("e")).select("kind", "e.*"), "piientities")


def disclosing_terms(docs: DataFrame, id_col: str, text_col: str, window: int | None, threshold: float, min_contexts: int) -> DataFrame | None:
    """(kind, term) for the terms above the threshold of an entity of the kind, or None if no pair has enough contexts."""
    key, cls = ["kind", "entity"], ["n_holding", "x", "y"]
    texts = id_and_text(docs, id_col, text_col)
    holding = materialise(texts.mapInArrow(tidied(_scan(window)), _HOLDING), "holding")
    every = holding.select("row", F.explode("entities").alias("e")).select("row", "e.*")
    entities = _entity_classes(every, min_contexts)
    most = entities.agg(F.max("n_entity")).first()[0]
    if most is None:
        return None
    n_docs = docs.count()
    total = F.lit(float(n_docs))

    def discloses(n_term: str, n_both: Column | str = "n_both"):
        pmi = F.log(total * (F.col(n_both) if isinstance(n_both, str) else n_both) / (F.col(n_term) * F.col("n_entity")))
        content = F.log(total / F.col("n_entity"))
        return (content > 0) & (pmi / content >= threshold)

    # A term stands in at least as many texts as in those that hold an entity: what fails by these fails by all.
    # As n_both <= n_entity, no term of more than N^(1 - threshold) n_entity^threshold texts discloses an entity.
    in_texts = holding.select("row", F.explode("terms").alias("term"))
    terms = in_texts.groupBy("term").agg(*_set_digest("row")).withColumnRenamed("n", "n_holding")
    if threshold > 0:
        terms = terms.where(F.col("n_holding") <= n_docs ** (1 - threshold) * most**threshold * (1 + 1e-9))
    terms = materialise(terms, "piiterms")
    one = terms.groupBy(*cls).agg(F.min("term").alias("term"))
    classes = in_texts.join(one, "term").select("row", *cls)
    known = join_counted(every, entities, key, "n_entity", every.count())
    chunks = known.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / _CHUNK).cast("int").alias("chunks"))
    known = materialise(known.join(chunks, "row").withColumn("chunk", F.pmod(F.xxhash64("entity"), "chunks").cast("int")).drop("chunks"), "piiknown")
    classes = classes.join(chunks, "row").select("row", *cls, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    classes = materialise(classes, "piiclasses")
    met = known.join(classes, ["row", "chunk"]).where(discloses("n_holding", F.least("n_holding", "n_entity")))
    likely = met.groupBy(*key, "n_entity", *cls).agg(F.count(F.lit(1)).alias("n_both")).where(discloses("n_holding"))
    if min_contexts > 1:
        likely = materialise(likely, "piilikely")
        shared = known.join(classes, ["row", "chunk"]).join(likely.select(*key, *cls), [*key, *cls], "left_semi")
        shared = shared.select(*key, *cls, "context").distinct().groupBy(*key, *cls).agg(F.count(F.lit(1)).alias("contexts"))
        likely = likely.join(shared.where(F.col("contexts") >= min_contexts).drop("contexts"), [*key, *cls])
    # Of the entities of one kind that share as many texts with a class, the one that is disclosed most easily decides.
    easiest = (F.min if threshold <= 1 else F.max)("n_entity").alias("n_entity")
    pairs = materialise(terms.join(likely.groupBy("kind", *cls, "n_both").agg(easiest), cls).select("kind", "term", "n_both", "n_entity"), "piipairs")
    marked = _term_bitmap(pairs)
    if not any(marked):
        return None
    in_all = texts.mapInArrow(tidied(_term_counts(marked)), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    return materialise(pairs.join(in_all, "term").where(discloses("n_term")).select("kind", "term").distinct(), "disclosing")


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int | None = WINDOW,
    threshold: float = DISCLOSURE,
    min_contexts: int = MIN_CONTEXTS,
) -> DataFrame:
    """Spans of personal data; terms of any length are scored, over all texts.

    One row per row of docs: row (its number), id, sha (of its text, if terms may be in it), base and added spans as arrays of (kind, start, end).

    Added spans (kind term_<kind>) mark every place, in any text, of the terms that disclose an
    entity, and never overlap base ones. The window only tells contexts apart. Null and empty texts
    have none. Repeated rows count as documents, but not as new contexts. An empty table gives an
    empty result; other columns are not read.
    """
    before = tables_now()
    disclosing = disclosing_terms(docs, id_col, text_col, window, threshold, min_contexts)
    settle(before, *([] if disclosing is None else [disclosing]))
    marked = _term_bitmap(disclosing) if disclosing is not None else None
    found = materialise(id_and_text(docs, id_col, text_col).mapInArrow(tidied(_marks(marked)), _FOUND), "personal")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    if disclosing is None:
        return found.select("row", F.col("id").alias(id_col), "sha", "base", none.alias("added"))
    places = found.where(F.size("places") > 0).select("row", F.explode("places").alias("p")).select("row", "p.*")
    span = F.struct(F.concat(F.lit("term_"), F.col("kind")).alias("kind"), "start", "end")
    hits = places.join(disclosing, "term").groupBy("row").agg(F.collect_set(span).alias("added"))
    out = found.select("row", "id", "sha", "base").join(hits, "row", "left")
    return out.select("row", F.col("id").alias(id_col), "sha", "base", F.coalesce("added", none).alias("added"))


def _ordered(base: list[dict], added: list[dict]) -> tuple[list[Span], list[Span]]:
    spans = [(s["kind"], s["start"], s["end"]) for s in base]
    more = sorted({(s["kind"], s["start"], s["end"]) for s in added}, key=lambda s: (KINDS.index(s[0][5:]), s[1]))
    return spans, spans + more


def personal_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of find_personal_data()'s spans."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = ([], [], [], [], [], [])
            for base, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans, both = _ordered(base, added)
                kinds = Counter(k for k, _, _ in spans)
                for column, value in zip(out, (*(kinds[k] for k in KINDS), digest(spans), joined(both))):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names)

    schema = "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return found.select(F.col(id_col).alias("id"), "base", "added").mapInArrow(tidied(digests), schema).withColumnRenamed("id", id_col)


def sanitise(text: str, base: list[dict], added: list[dict]) -> str:
    """The text with every span generalised to the label of its kind; of overlapping spans the one that starts first counts, then the longer."""
    spans = sorted([(s["start"], -s["end"], s["kind"]) for s in [*base, *added]])
    out, at = [], 0
    for start, end, kind in spans:
        if start < at:
            # What reaches beyond the span before it must not stay either.
            at = max(at, -end)
            continue
        out += [text[at:start], LABELS[kind.removeprefix("term_")]]
        at = -end
    return "".join([*out, text[at:]])


def sanitise_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs, with all columns, their texts sanitised and length_col, if given, brought in line where a text changed.

    Rows without added spans are rewritten by a map; only the others are shuffled, and matched by id
    and SHA-256 of the text. Null texts stay null; an empty table gives none. Repeated rows are rewritten alike.
    """
    before = tables_now()
    found = find_personal_data(docs, id_col, text_col)
    more = found.where(F.size("added") > 0).select(F.col(id_col).alias("id"), "sha", F.array_sort("added").alias("added")).distinct()
    more = materialise(more, "disclosing")
    settle(before, more)
    marked = bitmap(more, "id")
    names = list(docs.columns)
    at, length_at, id_at = names.index(text_col), names.index(length_col) if length_col else None, names.index(id_col)

    def rewritten(batch: pa.RecordBatch, added: list) -> pa.RecordBatch:
        texts, columns = batch.column(at).to_pylist(), list(batch.columns[: len(names)])
        lengths = columns[length_at].to_pylist() if length_at is not None else []
        for i, text in enumerate(texts):
            if text:
                base = [dict(zip(("kind", "start", "end"), s)) for s in base_spans(text.encode("utf-8", "replace"))]
                if base or added[i]:
                    texts[i] = sanitise(text, base, added[i] or [])
                    if length_at is not None:
                        lengths[i] = len(texts[i])
        columns[at] = pa.array(texts, columns[at].type)
        if length_at is not None:
            columns[length_at] = pa.array(lengths, columns[length_at].type)
        return pa.RecordBatch.from_arrays(columns, names)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(marked)
        for batch in slices(batches):
            part = batch.filter(pa.array(~in_bitmap(bits, batch.column(id_at).cast(pa.int64()))))
            yield rewritten(part, [None] * part.num_rows)

    def with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = pa.RecordBatch.from_struct_array(batch.column(0))
            yield rewritten(given, batch.column(1).to_pylist())

    sure = docs.mapInArrow(tidied(plain), docs.schema)
    if not any(marked):
        return sure
    # Written, so that no task runs two Python workers: this and the one behind the join.
    hit = materialise(split(docs, id_col, marked)[0], "hit")
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")), 256)
    keyed = hit.select(F.col(f"`{id_col}`").cast("long").alias("id"), sha.alias("sha"), whole_rows(docs).alias("doc")).alias("d")
    both = keyed.join(more.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.sha") == F.col("m.sha")), "left")
    return sure.unionByName(both.select("doc", "added").mapInArrow(tidied(with_terms), docs.schema))
