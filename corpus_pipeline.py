"""The corpus pipeline: stages over documents, each calling one operator of ``factloom.llm``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from factloom.llm import toxicity
from factloom.llm.common import short_batches, table, word_count
from factloom.llm.exact_dedup import exact_duplicates
from factloom.llm.jaccard_join import jaccard_join
from factloom.llm.mixing import copies_taken, mix
from factloom.llm.packing import pack, pieces
from factloom.session import discard, materialize

#: Rows up to which a written table of keys is broadcast, some 10 MB; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Metadata that marks the columns which a stage adds, whatever they had to be named.
ROLE = "corpus_pipeline"
#: Metadata of the key that names the table of keyed documents, and the tables of this session by that name.
TABLE, _KEYED = "corpus_pipeline_table", {}


def added(docs: DataFrame, role: str) -> str | None:
    """Name of the column that an earlier stage added in this role."""
    return next((f.name for f in docs.schema.fields if f.metadata.get(ROLE) == role), None)


def free(docs: DataFrame, role: str) -> str:
    """A name for a new column in this role, which no column of ``docs`` has in any case of letters."""
    taken, name = {c.lower() for c in docs.columns}, role
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key of their own for each row, written once and kept through the stages, and its name.

    Keys sort by id, null ids last, so the row with the smallest key is one with the smallest id; rows of
    equal or null ids are told apart by their place in the input. A column of the input that has the name of
    the key stays as it is, and the key gets another name. The copy of the documents that is written here is
    deleted once a stage gets a stored result, which no longer reads it.
    """
    short_batches(docs.sparkSession)
    key = added(docs, "row_key")
    if key is not None:
        _release(docs, docs.schema[key].metadata.get(TABLE))
        return docs, key
    own = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        own = F.lpad(F.hex(own.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    place = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    value = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.coalesce(own.cast("string"), F.lit("")), F.lit("-"), place)
    key, name = free(docs, "row_key"), uuid.uuid4().hex
    _KEYED[name] = materialize(docs.select("*", value.alias(key, metadata={ROLE: "row_key", TABLE: name})), "keyed")
    return _KEYED[name], key


def _release(docs: DataFrame, name: str | None) -> None:
    """Delete the keyed documents that ``docs`` came from, if ``docs`` reads files and none of them."""
    if name not in _KEYED:
        return
    own, files = _KEYED[name].written_to.rsplit("/", 1)[1], docs.inputFiles()
    if files and not any(own in file for file in files):
        discard(_KEYED.pop(name))


def _few(written: DataFrame) -> DataFrame:
    return F.broadcast(written) if written.count() <= BROADCAST_IDS else written


def _only(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not among the ids of ``dropped``."""
    dropped = _few(materialize(dropped.select("doc_id").distinct(), "dropped"))
    return docs.join(dropped, docs[key] == dropped["doc_id"], "left_anti")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores at 0.5 or more go; the labels of the corpus teach it."""
    docs, key = keyed(docs)
    lexicon = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _only(docs, key, toxicity.toxicity(docs, lexicon, key).where("predicted = 1"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, once."""
    docs, key = keyed(docs)
    return _only(docs, key, exact_duplicates(docs, key).where("doc_id <> keep_id"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at 0.8 the one with the smallest id stays."""
    docs, key = keyed(docs)
    found = jaccard_join(docs, width=5, num=8, den=10, id_col=key)
    return _only(docs, key, found.where("doc_id <> component_id"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; the last pass may end inside one.

    Each ``copy`` of a document has its own training ``position`` and else the columns of its document.
    Documents that the mix takes no word of, such as those without words, are absent.
    """
    docs, key = keyed(docs)
    mixed = mix(docs, key, spread=(F.col("doc_id"), F.md5("text")))
    taken = _few(materialize(copies_taken(mixed.where("taken > 0")), "taken"))
    whole = taken["words"] >= word_count(docs["text"])
    # Cut where a word ends, so that each part is a word with the white space before it.
    parts = F.split(docs["text"], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.array_join(F.slice(parts, F.lit(1), taken["words"].cast("int")), "")
    text = F.when(whole, docs["text"]).otherwise(part)
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        n_chars = F.when(whole, docs["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = n_chars.alias("n_chars")
    new = {role: free(docs, role) for role in ("copy", "position")}
    rows = docs.join(taken, docs[key] == taken["doc_id"]).select(
        *[changed.get(c, docs[c]) for c in docs.columns],
        *[taken[role].alias(name, metadata={ROLE: role}) for role, name in new.items()],
    )
    order = (new["position"], key, new["copy"])
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a training sequence; sequences follow the positions."""
    docs, key = keyed(docs)
    roles = [("row_key", key), *[(r, c) for r in ("copy", "position") if (c := added(docs, r))]]
    more = tuple(role for role, _ in roles)
    narrow = docs.select("doc_id", "text", *[F.col(c).alias(role) for role, c in roles])
    cut = pieces(narrow, public_tokenizers.path("byte_bpe_50k.json"), more=more)
    return pack(cut, keys=(*more[:2], "piece"), time="position") if len(more) == 3 else pack(cut, keys=("row_key", "piece"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
