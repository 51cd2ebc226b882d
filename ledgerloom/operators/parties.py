"""Parties of a document: names that are one party, and which of them is the filer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, shared_tokens
from ..sources.files import stored


def merge_pairs(entities: DataFrame, fragments: bool = True) -> DataFrame:
    """(DocID, KeyA, KeyB, Kind): names (DocID, Key) of one document that are one party.

    Prefix: one name's words are the other's first words. Fragment: a one-word name occurs in exactly one longer
    name; where it occurs in several, none is chosen. The join is on document and word, never on document alone.
    """
    base = entities.select("DocID", "Key").distinct().withColumn("words", F.split("Key", " ")).withColumn("First", F.get("words", F.lit(0))).withColumn("n", F.size("words"))
    a = base.select("DocID", "First", F.col("Key").alias("KeyA"), F.col("n").alias("nA"))
    b = base.select("DocID", "First", F.col("Key").alias("KeyB"), F.col("n").alias("nB"))
    prefix = a.join(b, ["DocID", "First"]).where("KeyA < KeyB").where(shared_tokens(F.col("KeyA"), F.col("KeyB")) >= F.least("nA", "nB")).select("DocID", "KeyA", "KeyB", F.lit("prefix").alias("Kind"))
    if not fragments:
        return prefix
    inner = base.where("n > 1").select("DocID", F.col("Key").alias("Host"), F.explode(F.array_distinct("words")).alias("Key"))
    met = base.where("n = 1").select("DocID", "Key").join(inner, ["DocID", "Key"]).withColumn("hosts", F.count("*").over(Window.partitionBy("DocID", "Key"))).where("hosts = 1")
    found = met.select("DocID", F.least("Key", "Host").alias("KeyA"), F.greatest("Key", "Host").alias("KeyB"), F.lit("fragment").alias("Kind"))
    return prefix.unionByName(found).groupBy("DocID", "KeyA", "KeyB").agg(F.max("Kind").alias("Kind"))


def group_parties(entities: DataFrame, fragments: bool = True) -> DataFrame:
    """(DocID, Key, PartyKey, MergeKind): the least name reachable over merge pairs within a document.

    The least label travels along pairs until nothing changes; documents are small graphs, so a handful of rounds
    settles all at once. Each round is written to the shared folder, so lost executors cost no more than one.
    """
    pairs = stored(merge_pairs(entities, fragments))
    both = pairs.select("DocID", F.col("KeyA").alias("Key"), F.col("KeyB").alias("Other")).union(pairs.select("DocID", "KeyB", "KeyA"))
    labels = entities.select("DocID", "Key").distinct().withColumn("PartyKey", F.col("Key"))
    while True:
        offered = both.join(labels.select("DocID", F.col("Key").alias("Other"), "PartyKey"), ["DocID", "Other"]).groupBy("DocID", "Key").agg(F.min("PartyKey").alias("offer"))
        stepped = labels.join(offered, ["DocID", "Key"], "left").select("DocID", "Key", F.least("PartyKey", F.coalesce("offer", "PartyKey")).alias("PartyKey"), (F.col("offer") < F.col("PartyKey")).alias("moved"))
        stepped = stored(stepped)
        moved = stepped.where("moved").limit(1).count()
        labels = stepped.drop("moved")
        if not moved:
            break
    kind = both.join(pairs, "DocID").where((F.col("Key") == F.col("KeyA")) | (F.col("Key") == F.col("KeyB"))).groupBy("DocID", "Key").agg(F.max("Kind").alias("Kind"))
    return labels.join(kind, ["DocID", "Key"], "left").select("DocID", "Key", "PartyKey", F.coalesce("Kind", F.lit("alone")).alias("MergeKind"))


def match_anchor(entities: DataFrame, anchors: DataFrame) -> DataFrame:
    """(DocID, Key, IsMatch, IsExact): whether a name and the document's anchor name share their first words, as many
    as the shorter has; exact if both have as many."""
    met = entities.select("DocID", "Key").distinct().join(anchors.select("DocID", "AnchorKey"), "DocID", "left")
    n, k = F.size(F.split("Key", " ")), F.size(F.split("AnchorKey", " "))
    match = F.coalesce(shared_tokens(F.col("Key"), F.col("AnchorKey")) >= F.least(n, k), F.lit(False)) & F.col("AnchorKey").isNotNull()
    return met.select("DocID", "Key", match.alias("IsMatch"), (match & (n == k)).alias("IsExact"))


def party_windows(mentions: DataFrame, lens: DataFrame, role: str = "registrant", tail: float = 0.1) -> DataFrame:
    """``mentions`` with Centre, Dist, TailStart and DocLen: a document's window lies around the first mention of its party of
    ``role``, and its tail is the last part of its text. Documents that do not mention that party have no centre."""
    first = mentions.where(F.col("PartyRole") == role).groupBy("DocID").agg(F.min("Start").alias("Centre"))
    met = mentions.join(lens.select("DocID", "DocLen"), "DocID").join(first, "DocID", "left")
    return met.withColumn("Dist", F.col("Start") - F.col("Centre")).withColumn("TailStart", F.floor(F.col("DocLen") * (1 - tail)))


def in_window(reach: Column | int) -> Column:
    """Whether a mention of ``party_windows`` starts within ``reach`` characters of the centre, inside the text."""
    half = F.lit(reach) if isinstance(reach, int) else reach
    inside = F.col("Start").between(F.greatest(F.col("Centre") - half, F.lit(0)), F.least(F.col("Centre") + half, F.col("DocLen")))
    return F.coalesce(inside, F.lit(False))


def window_role(reach: int = 2000) -> Column:
    """The part a mention plays: filer, co-filer, else counterparty in the window, else signatory in the tail, else other."""
    own = F.col("PartyRole").isin("registrant", "cofiler")
    return F.when(own, F.col("PartyRole")).when(in_window(reach), "counterparty").when(F.col("Start") >= F.col("TailStart"), "signatory").otherwise("other")


def filer_keys(register: DataFrame, names: DataFrame) -> DataFrame:
    """(DocID, FilerKey, IsPrimary): the normalised name of every filer of any copy of a document, once; its own filer counts first.

    ``register`` has DocID, HashDocument and CIK, ``names`` (CIK, Name). The filers of a text are made distinct before
    documents meet them, so a text of many copies is met by its few filers and not by all its copies.
    """
    keyed = register.join(names, "CIK").withColumn("FilerKey", norm_key(F.col("Name"))).where("FilerKey is not null")
    filers = keyed.select("HashDocument", "FilerKey").distinct()
    own = keyed.select("DocID", "FilerKey").distinct().withColumn("IsPrimary", F.lit(True))
    met = register.select("DocID", "HashDocument").distinct().join(filers, "HashDocument")
    return met.join(own, ["DocID", "FilerKey"], "left").select("DocID", "FilerKey", F.coalesce("IsPrimary", F.lit(False)).alias("IsPrimary")).distinct()


def anchor_keys(labelled: DataFrame, register: DataFrame, names: DataFrame, addresses: DataFrame) -> DataFrame:
    """(DocID, Class, AnchorName, AnchorKey, AnchorLen, Address): labelled documents with their filer's name, its key, and the
    address on record of their filing, of several the first by order. What is not known is null."""
    first = addresses.groupBy("HashIndex").agg(F.min_by("Address", "RecordNo").alias("Address"))
    met = labelled.join(register.select("DocID", "CIK", "HashIndex"), "DocID", "left").join(names, "CIK", "left").join(first, "HashIndex", "left")
    key = norm_key(F.col("Name"))
    return met.select("DocID", "Class", F.col("Name").alias("AnchorName"), key.alias("AnchorKey"), F.length(key).cast("long").alias("AnchorLen"), "Address")
