"""Inventories, retention, audit, review and keyed changes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table_stats(chunks: DataFrame) -> DataFrame:
    """One row: rows, distinct sources, largest id, rows without source, rows with blank text."""
    return chunks.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("source").alias("distinct_sources"),
        F.max("id").alias("max_id"),
        F.coalesce(F.sum(F.col("source").isNull().cast("long")), F.lit(0)).alias("null_sources"),
        F.coalesce(F.sum((F.trim(F.coalesce("content", F.lit(""))) == "").cast("long")), F.lit(0)).alias("blank_contents"),
    )


def data_inventory(chunks: DataFrame, policies: DataFrame, now: Column, default_days: int = 365) -> DataFrame:
    """One row for each case: counts, date range, days to expiry and the expired flag.

    policies(case_id, retention_days, legal_hold); a case without one gets default_days.
    """
    stats = chunks.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("source").alias("sources"),
        F.min("effective_date").alias("oldest"),
        F.max("effective_date").alias("newest"),
    )
    joined = stats.join(policies, "case_id", "left").withColumn("days", F.coalesce("retention_days", F.lit(default_days)))
    age = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp"))) / -86400.0 + F.col("days"))
    return joined.select(
        "case_id", "chunks", "sources", "oldest", "newest", F.coalesce("legal_hold", F.lit(False)).alias("legal_hold"),
        age.cast("long").alias("days_left"), (age <= 0).alias("expired"),
    )


#: A file below this size costs more to open than to read.
SMALL_FILE = 16 << 20


def stored_files(table: DataFrame, key: str | None = None) -> DataFrame:
    """(key, file, rows, bytes) of the files that a table was read from; a file with rows of several
    keys has a row for each."""
    about = table.metadataColumn("_metadata")
    group = [table[key].alias("key")] if key else [F.lit(None).cast("string").alias("key")]
    rows = table.select(*group, about.getField("file_path").alias("file"), about.getField("file_size").alias("bytes"))
    return rows.groupBy("key", "file", "bytes").agg(F.count(F.lit(1)).alias("rows")).select("key", "file", "rows", "bytes")


def relation_sizes(table: DataFrame, key: str) -> DataFrame:
    """(key, rows, files, bytes) of a stored table by key, such as a case: bytes of its files, those
    it shares with other keys in proportion to its rows."""
    files = stored_files(table, key)
    whole = files.groupBy("file").agg(F.sum("rows").alias("in_file"))
    share = F.col("bytes") * F.col("rows") / F.col("in_file")
    return files.join(whole, "file").groupBy("key").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.round(F.sum(share)).cast("long").alias("bytes")
    )


def table_diagnostics(table: DataFrame) -> DataFrame:
    """One row on a stored table's files: files, bytes, rows, files below SMALL_FILE, and the largest
    file's share of the rows; a hint whether to compact it or to deal it anew."""
    files = stored_files(table)
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum((F.col("bytes") < SMALL_FILE).cast("long")), F.lit(0)).alias("small_files"),
        F.coalesce(F.max("rows") / F.sum("rows"), F.lit(0.0)).alias("largest_share"),
    )


def column_diagnostics(table: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, blanks, mean_bytes) of each column, in one pass; blanks are texts
    of white space, mean_bytes those of filled texts."""
    texts = {c for c, t in table.dtypes if t == "string"}
    col = lambda c: F.col(f"`{c}`")
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    one = lambda c, t: F.struct(
        F.lit(c).alias("column"), F.lit(t).alias("type"), F.count(F.lit(1)).alias("rows"), count(col(c).isNull()).alias("nulls"),
        (count(F.trim(col(c)) == "") if c in texts else F.lit(0).cast("long")).alias("blanks"),
        (F.avg(F.octet_length(col(c))) if c in texts else F.lit(None).cast("double")).alias("mean_bytes"),
    )
    return table.agg(F.array(*[one(c, t) for c, t in table.dtypes]).alias("found")).select(F.inline("found"))


def source_lists(chunks: DataFrame) -> DataFrame:
    """(case_id, sources): the sorted distinct sources of each case."""
    return chunks.groupBy("case_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def set_sizes(sets: DataFrame) -> DataFrame:
    """sets with n_docs, the number of documents of each saved set (an array `docs`)."""
    return sets.withColumn("n_docs", F.coalesce(F.size("docs"), F.lit(0)))


def retention_sweep(inventory: DataFrame) -> DataFrame:
    """One row of totals; a case under legal hold is never deleted."""
    expired = F.coalesce("expired", F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return inventory.agg(
        F.count(F.lit(1)).alias("checked"),
        count(expired).alias("expired"),
        count(expired & ~F.col("legal_hold")).alias("deleted"),
        count(expired & F.col("legal_hold")).alias("held"),
    )


def delete_where(table: DataFrame, condition: Column, legal_hold: bool = False, force: bool = False) -> tuple[DataFrame, int]:
    """The rows that stay and the number deleted; a legal hold raises unless force is given."""
    if legal_hold and not force:
        raise PermissionError("the case is under legal hold")
    hit = F.coalesce(condition, F.lit(False))
    return table.where(~hit), table.where(hit).count()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, for each key that with the largest order; at a tie the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_new")


def unique_insert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; ValueError if a key of new is in old or repeated in new."""
    if not new.join(old, keys, "left_semi").isEmpty() or not new.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"a row with the same {', '.join(keys)} exists")
    return old.unionByName(new)


def recent_events(events: DataFrame, limit: int, event_type: str | None = None, case_id: str | None = None) -> DataFrame:
    """The last `limit` events, oldest first."""
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    if case_id is not None:
        events = events.where(F.col("case_id") == case_id)
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).orderBy("ts", "event_id")


def event_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def first_of_key(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first event of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_n", rank).where("_n = 1").drop("_n")


def review_metrics(items: DataFrame) -> DataFrame:
    """One row: counts by status, approval rate and mean latency in seconds."""
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0))
    reviewed = F.count(F.lit(1)) - n("pending")
    seconds = (F.unix_micros(F.col("reviewed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        n("pending").alias("pending"), n("approved").alias("approved"), n("edited").alias("edited"),
        n("rejected").alias("rejected"), n("escalated").alias("escalated"),
        F.round(n("approved", "edited") / F.greatest(reviewed, F.lit(1)), 4).alias("approval_rate"),
        F.round(F.avg(F.when(F.col("status") != "pending", seconds)), 1).alias("mean_latency_seconds"),
    )


TRANSITIONS = ("approved", "rejected", "edited", "escalated")


def transition(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items with decisions (review_id, new_status, edited_answer) applied to pending ones."""
    d = decisions.where(F.col("new_status").isin(*TRANSITIONS)).dropDuplicates(["review_id"])
    change = (F.col("status") == "pending") & F.col("new_status").isNotNull()
    return items.join(d, "review_id", "left").select(
        *[c for c in items.columns if c not in ("status", "edited_answer")],
        F.when(change, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(change, d["edited_answer"]).otherwise(items["edited_answer"] if "edited_answer" in items.columns else F.lit(None)).alias("edited_answer"),
    )


def feedback_export(items: DataFrame) -> DataFrame:
    """Decided items with the edited answer, or the original one where there is none."""
    answer = F.coalesce(F.nullif(F.col("edited_answer"), F.lit("")), F.col("answer"))
    return items.where(F.col("status").isin("approved", "edited", "rejected")).withColumn("answer", answer)


FLAG_ORDER = {"yes": 0, "no": 1}


def best_flag(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: yes before no before unflagged, the first among equals."""
    priority = F.when(F.col("flag") == "yes", 0).when(F.col("flag") == "no", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(priority, "seq"))
    return docs.withColumn("_n", rank).where("_n = 1").drop("_n")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n")


def document_cards(chunks: DataFrame, most: int = 5000) -> DataFrame:
    """(card, chunks, content): chunks grouped by message, else by subject and sender, else
    alone, their texts joined in order and cut to `most` characters."""
    text = lambda c: F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(""))
    pair = F.when(
        text("email_subject").isNotNull() | text("email_from").isNotNull(),
        F.concat_ws("||", F.coalesce(text("email_subject"), F.lit("")), F.coalesce(text("email_from"), F.lit(""))),
    )
    card = F.coalesce(text("message_id"), pair, F.concat(F.lit("id:"), F.col("id").cast("string")))
    rows = chunks.withColumn("card", card)
    # only lengths go by card; texts stay where they are until the first `most` characters are known
    before = Window.partitionBy("card").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.where("content is not null").select("card", "chunk_index", "id", (F.length("content") + 2).alias("size"))
    kept = sized.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < most)
    texts = rows.where("content is not null").select("card", "id", "chunk_index", "content").join(kept.select("card", "id").distinct(), ["card", "id"], "left_semi")
    joined = texts.groupBy("card").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content"))).alias("rows"))
    content = F.substring(F.array_join(F.transform("rows", lambda r: r["content"]), "\n\n"), 1, most)
    counted = rows.groupBy("card").agg(F.count(F.lit(1)).alias("chunks"))
    return counted.join(joined, "card", "left").select("card", "chunks", F.coalesce(content, F.lit("")).alias("content"))
