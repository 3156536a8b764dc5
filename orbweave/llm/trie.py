"""A trie over conversations: identical ones collapse to weighted sequences, those that others
go on from are told apart by an anti join, and weighted prefixes are aggregated."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.llm.common import checkpointed, map_sorted, map_stream

#: The prefix of no turns.
_ROOT = hashlib.sha256(b"").digest()
#: Ids are joined to strings of about so many bytes before those of one sequence meet.
ENDS_BYTES = 1 << 18


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, item, chars): each turn's place from 1, the SHA-256 of its role and text and
    the text's code points. By turn, null first, ties by item. A null role or text is the
    empty one; rows with a null id are of no conversation and left out. Texts aren't shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    item = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), item.alias("item"), F.char_length(text).cast("long").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "item"))
    return own.select("conv_id", place.cast("long").alias("pos"), "item", "chars")


def rebuilt(own: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations (conv_id, pos, item, chars) that share beginnings: the first h turns are those
    of the block's first conversation c - c % block (all it has, none if it isn't there), h being
    the CRC-32 of the id in decimal modulo `most`; then come c's own after its first h. Each has
    a row more, at 0, so that one without any turn stays."""
    own = checkpointed(own)
    head = F.crc32(F.col("conv_id").cast("string")) % most
    convs = own.where("pos = 1").select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % block).alias("b"), head.alias("h"))
    heads = own.where((F.col("pos") < most) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "b")
    shared = convs.join(heads, "b").where("pos <= h").select(F.col("c").alias("conv_id"), "pos", "item", "chars")
    empty = convs.select(F.col("c").alias("conv_id"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("chars"))
    return own.where(F.col("pos") > head).unionByName(shared).unionByName(empty)


def prefixes(items: DataFrame) -> DataFrame:
    """(conv_id, depth, prefix, parent, before, chars, last) for each conversation and depth from
    0: the hash of its first `depth` turns, chained from the one before, and the code
    points before its last text. One pass over rows sorted by conversation and place."""

    def make():
        held: dict = {}
        names = ("conv_id", "depth", "prefix", "parent", "before", "chars", "last")

        def flush(out: dict[str, list], last: bool) -> None:
            if held:
                for c in names[:-1]:
                    out[c].append(held[c])
                out["last"].append(last)

        def step(batch: pa.RecordBatch | None) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in names}
            if batch is None:
                flush(out, True)
                return out
            for conv, item, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "item", "chars")), strict=True):
                same = bool(held) and held["conv_id"] == conv
                flush(out, not same)
                if same:
                    parent = held["prefix"]
                    held.update(depth=held["depth"] + 1, prefix=hashlib.sha256(parent + item).digest(), parent=parent, before=held["before"] + held["chars"], chars=chars)
                else:
                    held.update(conv_id=conv, depth=0, prefix=_ROOT, parent=None, before=0, chars=0)
            return out

        return step

    return map_sorted(items, ["conv_id"], ["pos"], make, "conv_id long, depth long, prefix binary, parent binary, before long, chars long, last boolean")


def ends(finals: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of rows (prefix, conv_id): the digest of each prefix's ids, ascending
    and joined by commas. Ranges of prefix and id join what they have of a prefix first, so that one
    with very many ids is split; their strings then meet in order, one at a time."""

    def join():
        held: dict = {"prefix": None, "first": 0, "ids": [], "size": 0}

        def flush(out: dict[str, list]) -> None:
            if held["ids"]:
                for c, v in zip(out, (held["prefix"], held["first"], ",".join(held["ids"])), strict=True):
                    out[c].append(v)
            held.update(ids=[], size=0)

        def step(batch: pa.RecordBatch | None) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("prefix", "first", "ids")}
            if batch is None:
                flush(out)
                return out
            for prefix, conv in zip(batch.column("prefix").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if prefix != held["prefix"] or held["size"] > ENDS_BYTES:
                    flush(out)
                    held.update(prefix=prefix, first=conv)
                held["ids"].append(str(conv))
                held["size"] += len(held["ids"][-1]) + 1
            return out

        return step

    def digest():
        held: dict = {"prefix": None, "all": None}

        def flush(out: dict[str, list]) -> None:
            if held["all"] is not None:
                out["prefix"].append(held["prefix"])
                out["ends_sha256"].append(held["all"].hexdigest())

        def step(batch: pa.RecordBatch | None) -> dict[str, list]:
            out: dict[str, list] = {"prefix": [], "ends_sha256": []}
            if batch is None:
                flush(out)
                return out
            for prefix, ids in zip(batch.column("prefix").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held["all"] is not None and prefix == held["prefix"]:
                    held["all"].update(b"," + ids.encode())
                else:
                    flush(out)
                    held.update(prefix=prefix, all=hashlib.sha256(ids.encode()))
            return out

        return step

    dealt = finals.select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    strings = map_stream(dealt, join, "prefix binary, first long, ids string")
    return map_sorted(strings, ["prefix"], ["first"], digest, "prefix binary, ends_sha256 string", "ids")


def prefix_trie(items: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, pos, item, chars), each with a row at 0, one row a node:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct beginning and has as members the conversations that begin so; its
    conv_id is the smallest, saved_tokens sums (n_convs - 1) times the last text's code points over
    its subtree, ends_sha256 is of the members that end there. No conversations give no nodes.

    Sums over subtrees need no pairs of node and ancestor. All that a sequence's members have from
    a depth on is its weight times what it has from there. What the nodes themselves have
    counts once a node: for the least leaf below it. The nodes of which a leaf is the least
    are the lower end of its path, so a leaf gives each node above what that end has.
    """
    chains = checkpointed(prefixes(items))
    finals = chains.where("last")
    sequences = finals.groupBy(F.col("prefix").alias("seq")).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.first(F.col("before") + F.col("chars")).alias("total"))
    sequences = checkpointed(sequences)
    longer = chains.where(~F.col("last")).select(F.col("prefix").alias("seq")).distinct()
    leaves = sequences.join(longer, "seq", "left_anti").select("seq", F.lit(True).alias("leaf"))
    told = sequences.join(leaves, "seq", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    paths = checkpointed(chains.drop("last").join(told, "conv_id"))
    least = paths.where("leaf").groupBy("prefix").agg(F.min("seq").alias("seq"), F.min("before").alias("before"))
    tops = least.groupBy("seq").agg(F.min("before").alias("top"))
    all_below = F.col("weight") * (F.col("total") - F.col("before"))
    own_below = F.when(F.col("leaf"), F.col("total") - F.greatest("before", "top")).otherwise(F.lit(0))
    nodes = paths.join(tops, "seq", "left").groupBy("prefix").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(all_below - own_below).alias("saved_tokens"),
    )
    nodes = checkpointed(nodes)
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, "prefix", "left").join(ends(finals), "prefix", "left").join(parents, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
