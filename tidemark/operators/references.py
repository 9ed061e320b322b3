"""References to records that do not exist, by bitmap difference.

All keys that occur are encoded as dense integers by a dictionary (``dictionary_encode``), so
keys of any kind and any gaps fill the bitmaps densely.  A bitmap covers one range of
``RANGE`` codes for one table and period and is built by partial aggregation, which makes a key
referenced a million times in a month one bit before anything is shuffled; only ranges with a
bit exist, and the shuffle compresses their blocks.  Per range, references AND NOT parents
leaves the bits of missing and deleted records, and references AND the parents born in or after
their period those that can be late.  Surviving bits are decoded and met with the references
again, salted, since one dangling placeholder may hold a third of all rows.

Defined cases: null references are none; equal rows give one result; a reference without a
time has a null period and can not be late; a memory without ``created_at`` exists and is
never late; a JSON text counts only if the whole text is valid JSON and an array, and only
elements that are objects with an integral ``id`` (number or quoted digits) of 64 bits; empty
tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

STRICT_JSON = {
    "mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false", "allowComments": "false", "allowNumericLeadingZeros": "false",
    "allowBackslashEscapingAnyCharacter": "false", "allowUnquotedControlChars": "false",
}
#: Copies of every surviving key, against hot keys when meeting the references again.
SALTS = 16
#: Codes of one bitmap (a block of 4 kB), and keys of one task of the dictionary.
RANGE, BLOCK_KEYS = 32_768, 1_000_000


def whole_json_array(text: Column) -> Column:
    """The raw texts of the elements where the whole of ``text`` is one valid JSON array,
    else null.  The parser stops after a first complete value, so the text is wrapped once
    as array element and once as member: what follows a complete value would have to be
    ``]`` and ``}`` at once to pass both."""
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT_JSON)
    in_object = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v:array<string>>", STRICT_JSON)
    return F.when((F.size(in_array) == 1) & F.col("text_kind").eqNullSafe("["), in_object["v"])


def used_ids(log: DataFrame, column: str = "knowledge_used", keep: list[str] | None = None) -> DataFrame:
    """(id, created_at, keep, target_id) of every element of the JSON array ``column``."""
    keep = keep or []
    text = F.col(column)
    slim = log.select("id", "created_at", *keep, text.alias("used")).withColumn(
        "text_kind", F.substring(F.regexp_replace("used", r"^\s+", ""), 1, 1)
    )
    items = slim.select("id", "created_at", *keep, F.explode(whole_json_array(F.col("used"))).alias("item"))
    ident = F.trim(F.get_json_object("item", "$.id"))
    target = F.when(ident.rlike(r"^-?\d{1,19}$"), ident).try_cast("long")
    return items.select("id", "created_at", *keep, target.alias("target_id"))


def dictionary_encode(values: DataFrame, column: str, blocks: int | None = None) -> DataFrame:
    """(value, code): dense integer codes for the distinct non-null values, without one task
    seeing all of them: codes count up inside hash blocks, offset by the blocks before."""
    uniq = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    if blocks is None:
        uniq = materialise(uniq, "keys")
        blocks = max(1, -(-uniq.count() // BLOCK_KEYS))
    uniq = uniq.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)))
    sizes = uniq.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("off"))  # one row per block
    rank = F.row_number().over(Window.partitionBy("block").orderBy("value")) - 1
    return uniq.withColumn("r", rank).join(F.broadcast(offsets), "block").select("value", (F.col("off") + F.col("r")).alias("code"))


def bitmaps(codes: DataFrame, group: list[str]) -> DataFrame:
    """(group, range, bits): one bitmap per group and range of ``RANGE`` values of ``code``."""
    return codes.groupBy(*group, F.floor(F.col("code") / RANGE).alias("range")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("code"), F.lit(RANGE))).alias("bits")
    )


def set_bits(bits: np.ndarray, start: int) -> np.ndarray:
    """The codes a block of bytes stands for, from ``start`` on."""
    return np.nonzero(np.unpackbits(bits, bitorder="little"))[0].astype(np.int64) + start


_STATES = pa.schema([("table_name", pa.string()), ("ref_month", pa.string()), ("code", pa.int64()), ("state", pa.string())])


def _differences(key: tuple, table: pa.Table) -> pa.Table:
    """Of the bitmaps of one range, the codes that are missing, deleted or perhaps late."""
    start = key[0].as_py() * RANGE
    none = np.zeros(RANGE // 8, np.uint8)
    there, gone, births, asked = none, none, {}, []
    for row in table.to_pylist():
        bits = np.frombuffer(row["bits"], np.uint8)
        if row["role"] == "parent":
            there = there | bits
            if row["month"] is not None:
                births[row["month"]] = bits
        elif row["role"] == "deleted":
            gone = gone | bits
        else:
            asked.append((row["table_name"], row["month"], bits))
    out = []
    for name, month, bits in asked:
        young = none
        for born, some in births.items():
            if month is not None and born >= month:
                young = young | some
        absent = bits & ~there
        for state, left in (("missing", absent & ~gone), ("deleted", absent & gone), ("late", bits & young)):
            codes = set_bits(left, start)
            if len(codes):
                n = len(codes)
                out.append(pa.Table.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([month] * n, pa.string()), pa.array(codes), pa.array([state] * n, pa.string())],
                    schema=_STATES,
                ))
    return pa.concat_tables(out) if out else _STATES.empty_table()


def all_references(knowledge: DataFrame, versions: DataFrame, feedback: DataFrame, interactions: DataFrame) -> DataFrame:
    """(table_name, row_id, target_id, ref_time) of every non-null reference."""
    def part(df: DataFrame, table: str, row: str, target: str, time: str) -> DataFrame:
        return df.select(
            F.lit(table).alias("table_name"), F.col(row).cast("long").alias("row_id"),
            F.col(target).cast("long").alias("target_id"), F.col(time).alias("ref_time"),
        )

    parts = [
        part(feedback, "feedback_log", "id", "knowledge_id", "created_at"),
        part(versions, "knowledge_versions", "id", "knowledge_id", "created_at"),
        part(used_ids(interactions), "interaction_log", "id", "target_id", "created_at"),
        part(knowledge, "unified_knowledge", "id", "replaced_by", "updated_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("target_id").isNotNull()).withColumn("ref_month", F.date_format("ref_time", "yyyy-MM"))


def orphan_references(
    references: DataFrame, parents: DataFrame, deleted: DataFrame, salts: int = SALTS
) -> DataFrame:
    """(table_name, ref_month, row_id, target_id, state), distinct; ``parents`` has (id,
    created_at), ``deleted`` has (knowledge_id).  State is missing, deleted or late."""
    used = references.select("table_name", F.col("ref_month").alias("month"), F.col("target_id").alias("key")).distinct()
    used = materialise(used, "used-keys")
    known = parents.select(F.col("id").cast("long").alias("key"), F.date_format("created_at", "yyyy-MM").alias("month"))
    dead = deleted.select(F.col("knowledge_id").cast("long").alias("key"))
    book = materialise(dictionary_encode(used.select("key").unionByName(known.select("key")).unionByName(dead), "key"), "dictionary")
    nothing = F.lit(None).cast("string")
    roles = (
        used.select(F.lit("reference").alias("role"), "table_name", "month", "key")
        .unionByName(known.select(F.lit("parent").alias("role"), nothing.alias("table_name"), "month", "key"))
        .unionByName(dead.select(F.lit("deleted").alias("role"), nothing.alias("table_name"), nothing.alias("month"), "key"))
    )
    coded = roles.join(book.withColumnRenamed("value", "key"), "key")
    left = bitmaps(coded, ["role", "table_name", "month"]).groupBy("range").applyInArrow(
        _differences, "table_name string, ref_month string, code long, state string"
    )
    keys = left.join(book, "code").select("table_name", "ref_month", F.col("value").alias("target_id"), "state")
    # a month that can be late is settled by the exact times
    births = parents.select(F.col("id").cast("long").alias("target_id"), F.lit("late").alias("state"), F.col("created_at").alias("born"))
    keys = keys.join(births, ["target_id", "state"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = references.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    same = [
        salted["table_name"] == keys["table_name"], salted["ref_month"].eqNullSafe(keys["ref_month"]),
        salted["target_id"] == keys["target_id"], salted["salt"] == keys["salt"],
    ]
    return salted.join(keys, same).filter((F.col("state") != "late") | (F.col("born") > F.col("ref_time"))).select(
        salted["table_name"], salted["ref_month"], "row_id", salted["target_id"], "state"
    ).distinct()


def orphan_report(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table and month: distinct references, and how many are missing, deleted, late."""
    total = references.select("table_name", "ref_month", "row_id", "target_id").distinct().groupBy(
        "table_name", "ref_month"
    ).agg(F.count(F.lit(1)).alias("n_references"))
    states = orphans.groupBy("table_name", "ref_month").agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("missing", "deleted", "late")]
    )
    joined = total.alias("t").join(
        states.alias("s"),
        (F.col("t.table_name") == F.col("s.table_name")) & F.col("t.ref_month").eqNullSafe(F.col("s.ref_month")), "left",
    )
    return joined.select(
        "t.table_name", "t.ref_month", "n_references",
        *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in ("missing", "deleted", "late")],
    )
