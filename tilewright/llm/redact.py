"""Finding and replacing personal information in a corpus.

A first pass over all texts learns parts of names that the lexicon lacks, from where they stand beside known ones; the
counts are combined per batch and summed by word. The second pass is a map over documents, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import pii
from tilewright.llm.surrogates import Surrogates, canonical, name_parts
from tilewright.session import cut

#: Parts of names sent to the executors at most; a larger lexicon raises instead of being cut.
MOST_PARTS = 300_000


def lexicon_parts(lexicon: DataFrame) -> list[tuple[str, int]]:
    """The lexicon (a stated list of bounded size, checked), trimmed. Rows of other kinds are ignored."""
    rows = lexicon.where(F.col("name_text").isNotNull() & F.lower("name_kind").isin("given", "family"))
    rows = rows.select(F.trim("name_text").alias("t"), F.lower("name_kind").alias("k")).where("t != ''").distinct().limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts of names")
    return [(r["t"], pii.GIVEN if r["k"] == "given" else pii.FAMILY) for r in rows]


def learned_parts(docs: DataFrame, parts: list[tuple[str, int]], text: str = "text") -> list[tuple[str, int]]:
    """Parts of names that the lexicon lacks, by pii.enough over all documents."""
    return learned(docs, parts, text)[0]


def learned(docs: DataFrame, parts: list[tuple[str, int]], text: str = "text") -> tuple[list[tuple[str, int]], dict[str, str]]:
    """Those parts, and the sex of given names by the titles that stand before them, in one pass.

    Of a word's partners each batch passes on the pii.PARTNERS with the least hashes, as many as pii.enough asks about, so
    the numbers it asks about are exact (but for equal 64-bit hashes) and no state grows with how common a word is.
    """
    known = pii.Names.of(parts)
    if not parts:
        return [], {}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            partners: dict[tuple[str, int], set[int]] = {}
            for (word, role, partner), n in pii.name_evidence(batch.column(0).to_pylist(), known).items():
                counts[word, role] = counts.get((word, role), 0) + n
                if role in (pii.GIVEN, pii.FAMILY):
                    partners.setdefault((word, role), set()).add(int.from_bytes(hashlib.blake2b(partner.encode(), digest_size=8).digest(), "big", signed=True))
            out = [(*k, n if not i else 0, p) for k, n in counts.items() for i, p in enumerate(sorted(partners.get(k, {0}))[: pii.PARTNERS])]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["word", "role", "n", "partner"])

    rows = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(scan, "word string, role int, n long, partner long")
    each = rows.groupBy("word", "role", "partner").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("role") == k, F.col("n")).otherwise(0))
    words = each.groupBy("word").agg(*[c for k, w in ((1, "g"), (2, "f")) for c in (of(k).alias(f"n_{w}"), F.count_if(F.col("role") == k).alias(f"p_{w}"))], of(0).alias("n_all"), of(pii.MALE).alias("n_male"), of(pii.FEMALE).alias("n_female"))
    named = ((F.col("p_g") >= 2) | (F.col("p_f") >= 2)) & (F.greatest("n_g", "n_f") >= pii.LEAST_SHARE * F.col("n_all"))
    titled = F.greatest("n_male", "n_female") >= 0.02 * F.col("n_all")  # far more than chance puts behind a title
    likely = words.where(named | titled).limit(MOST_PARTS + 1).collect()
    if len(likely) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts of names")
    found = [(r["word"], role) for r in likely for role, w in ((pii.GIVEN, "g"), (pii.FAMILY, "f")) if pii.enough(r[f"p_{w}"], r[f"n_{w}"], r["n_all"])]
    return found, {r["word"]: "m" if r["n_male"] > r["n_female"] else "f" for r in likely if r["n_male"] != r["n_female"]}


def known_names(docs: DataFrame, lexicon: DataFrame) -> pii.Names:
    parts = lexicon_parts(lexicon)
    more, sexes = learned(docs, parts)
    return pii.Names.of(parts + more, sexes)


def find_pii(docs: DataFrame, lexicon: DataFrame, names: pii.Names | None = None) -> DataFrame:
    """doc_id, pii_type, pii_value: each distinct piece of a document, exactly as written.

    Null and empty texts give nothing; a repeated document gives repeated rows; an empty lexicon leaves names out.
    """
    known = names or known_names(docs, lexicon)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for kind, value in dict.fromkeys((k, text[a:b]) for a, b, k in pii.find(text, known)):
                    at.append(i)
                    kinds.append(kind)
                    values.append(value)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["doc_id", "pii_type", "pii_value"])

    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()).mapInArrow(scan, "doc_id long, pii_type string, pii_value string")


def entities(found: DataFrame, key: bytes, names: pii.Names, attempts: dict | None = None) -> DataFrame:
    """pii_type, entity, surrogate: one row per original, however often and in whichever way it is written."""
    made = Surrogates(key, name_parts(key, list(names.roles), names.sexes), attempts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = [canonical(k, v) for k, v in zip(kinds, values)]
            new = [canonical(k, made.replace(k, v)) for k, v in zip(kinds, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string()), pa.array(new, pa.string())], names=["pii_type", "entity", "surrogate"])

    once = found.select("pii_type", "pii_value").distinct()
    return once.mapInArrow(scan, "pii_type string, entity string, surrogate string").groupBy("pii_type", "entity").agg(F.min("surrogate").alias("surrogate"))


def collision_attempts(found: DataFrame, key: bytes, names: pii.Names, rounds: int = 4) -> dict[tuple[str, str], int]:
    """For originals whose replacement was that of another one, the attempt that keeps them apart. Expected to be none:
    words have some 60 bits; numbers and parts of names can't clash. Texts are searched once: what was found, each piece
    once, is kept in the shared folder, and rounds only look at that."""
    attempts: dict[tuple[str, str], int] = {}
    found = cut(found.select("pii_type", "pii_value").distinct())
    for _ in range(rounds):
        table = entities(found, key, names, attempts)
        clashes = table.groupBy("pii_type", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first")).where("n > 1")
        moved = table.join(clashes, ["pii_type", "surrogate"]).where((F.col("entity") != F.col("first")) & F.col("pii_type").isin("email", "address")).select("pii_type", "entity").limit(MOST_PARTS + 1).collect()
        if not moved:
            return attempts
        if len(moved) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} replacements clash")
        for r in moved:
            attempts[r["pii_type"], r["entity"]] = attempts.get((r["pii_type"], r["entity"]), 0) + 1
    raise ValueError(f"replacements still clash after {rounds} rounds")


def redact(docs: DataFrame, lexicon: DataFrame, key: bytes, style: str = "typed", check: bool = True) -> DataFrame:
    """doc_id, text, n_replaced: the text with each piece replaced, and all else untouched.

    ``typed`` puts placeholders such as [PHONE:01632 914402] that carry the surrogate, ``surrogate`` the bare surrogate,
    ``type`` only [PHONE]. Null texts stay null. ``check`` runs the collision check over the whole corpus first.
    """
    known = known_names(docs, lexicon)
    attempts = collision_attempts(find_pii(docs, lexicon, known), key, known) if check and style != "type" else {}
    made = Surrogates(key, name_parts(key, list(known.roles), known.sexes), attempts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for text in batch.column(1).to_pylist():
                pieces, at, n = [], 0, 0
                for a, b, kind in pii.find(text, known):
                    label = "" if style == "surrogate" else kind.upper()
                    new = "" if style == "type" else made.replace(kind, text[a:b])
                    pieces += [text[at:a], new if not label else f"[{label}]" if not new else f"[{label}:{new}]"]
                    at, n = b, n + 1
                out.append(None if text is None else "".join([*pieces, text[at:]]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_replaced"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, text string, n_replaced int")
