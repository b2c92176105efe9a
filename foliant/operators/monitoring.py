"""Operations monitoring, top lists, retention, quality of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import patterns as P
from foliant.operators.billing import at, elapsed_days
from foliant.operators.usage import count_where, percent, zero

ATTENTION_DAYS, ABANDON_DAYS, TOO_MANY = 3, 14, 30


def age(now: str) -> Column:
    return F.coalesce(elapsed_days(F.col("updated_at"), at(now)), zero())


def documents_by_status(docs: DataFrame, now: str) -> DataFrame:
    """Per status total, mean age (1 decimal), largest age, and how many are over 3 and 14 days old."""
    rows = docs.withColumn("age", age(now))
    tenths = F.floor((F.sum("age") * 20 + F.count("*")).cast("double") / (F.count("*") * 2))
    return rows.groupBy("status").agg(
        F.count("*").alias("total"), (tenths / 10).alias("mean_age"), F.max("age").alias("max_age"),
        count_where(F.col("age") >= ATTENTION_DAYS).alias("attention"), count_where(F.col("age") >= ABANDON_DAYS).alias("abandoned"),
    )


def status_histogram(docs: DataFrame) -> DataFrame:
    """Documents by status, and of all of them."""
    counts = docs.groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a status


def pending_clarifications(clarifications: DataFrame) -> DataFrame:
    """Open questions per document, with whether they are too many."""
    return clarifications.where("answered_at is null").groupBy("doc_id").agg(F.count("*").alias("pending")).withColumn(
        "excessive", F.col("pending") >= TOO_MANY
    )


def clarification_totals(clarifications: DataFrame) -> DataFrame:
    """One row: open questions, documents with some, the most loaded document."""
    per = pending_clarifications(clarifications)
    return per.agg(
        F.coalesce(F.sum("pending"), zero()).alias("pending"), F.count("*").alias("documents"),
        F.max_by("doc_id", F.struct("pending", -F.col("doc_id"))).alias("heaviest"), F.max("pending").alias("heaviest_pending"),
    )


def pipeline_share(docs: DataFrame) -> DataFrame:
    """Documents of the native pipeline against those of none; others don't count."""
    native, old = count_where("pipeline = 'native'"), count_where("pipeline is null")
    return docs.agg(native.alias("native"), old.alias("old")).select("*", percent(F.col("native"), F.col("native") + F.col("old")).alias("share"))


def queue_health(jobs: DataFrame) -> DataFrame:
    """One row: backlog, failed jobs and the oldest failure (jobs: id, failed_at)."""
    return jobs.agg(count_where("failed_at is null").alias("backlog"), F.count("failed_at").alias("failed"), F.min("failed_at").alias("oldest_failure"))


def classification_quality(blocks: DataFrame, clarifications: DataFrame, latest: int = 100) -> DataFrame:
    """The latest documents, the worst first: blocks, headings, ambiguous ones, share decided automatically."""
    per = blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), count_where("type = 'heading'").alias("headings"), count_where("confidence < 0.85").alias("ambiguous")
    )
    pending = pending_clarifications(clarifications).select("doc_id", "pending")
    rows = per.join(pending, "doc_id", "left").select(
        "doc_id", "blocks", "headings", "ambiguous", percent(F.col("blocks") - F.col("ambiguous"), F.col("blocks")).alias("auto_rate"),
        (F.col("headings") == 0).alias("no_heading"), F.coalesce("pending", zero()).alias("pending"),
    )
    return rows.orderBy(F.desc("doc_id")).limit(latest).orderBy("auto_rate", "doc_id")


def corpus_quality(blocks: DataFrame, clarifications: DataFrame) -> DataFrame:
    """One row over all documents: documents, those without headings, blocks, headings, ambiguous ones, questions
    that wait, and the share decided automatically."""
    per = blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), count_where("type = 'heading'").alias("headings"), count_where("confidence < 0.85").alias("ambiguous")
    )
    waiting = clarifications.where("answered_at is null").agg(F.count("*").alias("pending")).withColumn("one", F.lit(1))
    sums = per.agg(
        F.count("*").alias("documents"), count_where("headings = 0").alias("without_heading"),
        *[F.coalesce(F.sum(c), zero()).alias(c) for c in ("blocks", "headings", "ambiguous")],
    ).withColumn("one", F.lit(1))
    rate = percent(F.col("blocks") - F.col("ambiguous"), F.col("blocks"))
    return sums.join(waiting, "one").drop("one").withColumn("auto_rate", rate)


def user_totals(users: DataFrame) -> DataFrame:
    """G25."""
    return users.agg(
        F.count("*").alias("users"), count_where("is_admin").alias("admins"), count_where("is_suspended").alias("suspended"),
        F.coalesce(F.sum("credits_balance"), zero()).alias("credits"),
    )


def document_diagnostics(typed: DataFrame) -> DataFrame:
    """Per document paragraphs, empty ones, longest empty run, tables, styled titles, contents entries, warnings."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    empty = (F.col("type") == "paragraph") & (P.trimmed(F.col("text")) == "")
    filled = F.last(F.when(~empty, F.col("pos")), True).over(order)
    rows = typed.withColumn("empty", empty).withColumn("run", F.when(F.col("empty"), F.col("pos") - F.coalesce(filled, F.lit(-1))).otherwise(0).cast("long"))
    per = rows.groupBy("doc_id").agg(
        count_where("type = 'paragraph'").alias("paragraphs"), count_where("type = 'paragraph' and not empty").alias("filled"), count_where("empty").alias("empty"),
        F.max("run").alias("longest_empty_run"), count_where("type = 'table'").alias("tables"), count_where("style_level is not null").alias("styled"),
        count_where("type = 'toc_entry'").alias("toc_entries"), count_where("type = 'caption' and style_level is not null").alias("styled_captions"),
    )
    notes = F.concat_ws(",", F.when(F.col("longest_empty_run") >= 3, "empty_run"), F.when(F.col("styled_captions") > 0, "styled_caption"))
    return per.withColumn("warnings", notes).drop("styled_captions")


def detection_compare(typed: DataFrame) -> DataFrame:
    """Headings, captions, tables and images per document."""
    kinds = ("heading", "caption", "table", "figure")
    return typed.groupBy("doc_id").agg(*[count_where(F.col("type") == k).alias(f"{k}s") for k in kinds])


def detection_eval(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions (doc_id, pos, rule) against true (doc_id, pos): found, right, precision; recall over all rules.

    Precision and recall are in percent with one decimal.
    """
    rows = predicted.join(truth.withColumn("true", F.lit(True)), ["doc_id", "pos"], "full")
    right = F.count(F.when(F.col("true") & F.col("rule").isNotNull(), 1))
    per = rows.groupBy("rule").agg(F.count("*").alias("found"), right.alias("right"))
    total = F.sum(F.when(F.col("rule").isNull(), F.col("found")).otherwise(F.col("right"))).over(Window.partitionBy())
    return (
        per.withColumn("truth", total).where("rule is not null")
        .select("rule", "found", "right", percent(F.col("right"), F.col("found")).alias("precision"), percent(F.col("right"), F.col("truth")).alias("recall"))
    )


def detection_curve(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall by confidence: of predictions (doc_id, pos, confidence) at or above each one there is.

    Numbers are added up by confidence, then within thousandths of it, and thousandths are added up among themselves: at
    most 1,001 of them for confidences from 0 to 1, so no order goes over all rows. Percents have one decimal.
    """
    right = predicted.join(truth.select("doc_id", "pos").distinct().withColumn("true", F.lit(True)), ["doc_id", "pos"], "left")
    by = right.groupBy("confidence").agg(F.count("*").alias("n"), F.count("true").alias("r")).withColumn("part", F.floor(F.col("confidence") * 1000))
    parts = by.groupBy("part").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    higher = F.sort_array(F.collect_list(F.struct("part", "n", "r")), asc=False)
    add = lambda at, name: F.aggregate(F.slice("every", 1, at), F.lit(0).cast("long"), lambda total, x: total + x[name])
    above = parts.agg(higher.alias("every")).select("every", F.posexplode("every")).select(F.col("col.part").alias("part"), add(F.col("pos"), "n").alias("n_above"), add(F.col("pos"), "r").alias("r_above"))
    within = Window.partitionBy("part").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.join(above, "part").select(
        "confidence", (F.col("n_above") + F.sum("n").over(within)).alias("found"), (F.col("r_above") + F.sum("r").over(within)).alias("right")
    )
    total = truth.select("doc_id", "pos").distinct().count()
    return run.select("confidence", "found", "right", percent(F.col("right"), F.col("found")).alias("precision"), percent(F.col("right"), F.lit(total)).alias("recall"))


def document_report(blocks: DataFrame, changes: DataFrame, references: DataFrame, covers: DataFrame) -> DataFrame:
    """Twelve counters per document."""
    kind = lambda *k: count_where(F.col("type").isin(*k))
    per = blocks.groupBy("doc_id").agg(
        kind("heading").alias("headings"), count_where("type = 'heading' and confidence >= 0.85").alias("headings_confirmed"),
        count_where("type = 'heading' and confidence < 0.85").alias("headings_to_validate"), kind("table").alias("tables"),
        kind("figure", "image").alias("figures"), kind("caption").alias("captions"), kind("toc_entry").alias("toc_entries"), kind("shape").alias("shapes"),
        F.coalesce(F.sum(F.when(F.col("page_break_before"), F.col("empties"))), zero()).alias("empties_normalized"),
    )
    renumbered = changes.where("original_number is not null").groupBy("doc_id").agg(F.count("*").alias("renumbered"))
    resolved = references.where("target_id is not null").groupBy("doc_id").agg(F.count("*").alias("refs_resolved"))
    cut = covers.where("verdict = 'remove'").select("doc_id", F.col("blocks").alias("cover_blocks"))
    rows = per.join(renumbered, "doc_id", "left").join(resolved, "doc_id", "left").join(cut, "doc_id", "left")
    return rows.select(*[F.coalesce(c, zero()).alias(c) if c in ("renumbered", "refs_resolved", "cover_blocks") else c for c in rows.columns])


def report_warnings(report: DataFrame) -> DataFrame:
    """A row for each warning of a document."""
    rules = (("headings_to_validate", "headings_to_validate > 0"), ("no_heading", "headings = 0"), ("figures_without_caption", "figures > captions"))
    parts = [report.where(cond).select("doc_id", F.lit(name).alias("warning")) for name, cond in rules]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def table_stats(tables: DataFrame) -> DataFrame:
    """Per document tables, cells, tables with a header and with merged cells, and a hash of their content.

    ``tables``: doc_id, rows, cols, cells array<array<string>>, grid_span array<array<int>>. A header: at least two rows,
    and the first cell spans all columns or the first row is filled and short.
    """
    first = F.get("cells", F.lit(0))
    filled = F.forall(first, lambda x: (P.trimmed(x) != "") & (F.length(P.trimmed(x)) <= 40))
    spans = (F.get(F.get("grid_span", F.lit(0)), F.lit(0)) == F.col("cols")) & (F.col("cols") > 1)
    header = (F.col("rows") >= 2) & (F.coalesce(spans, F.lit(False)) | filled)
    merged = F.exists("grid_span", lambda r: F.exists(r, lambda x: x > 1))
    return tables.groupBy("doc_id").agg(
        F.count("*").alias("tables"), F.sum(F.col("rows") * F.col("cols")).cast("long").alias("cells"), F.count(F.when(header, 1)).alias("with_header"),
        F.count(F.when(merged, 1)).alias("with_merges"), F.expr("bit_xor(xxhash64(cells, grid_span))").alias("content_hash"),
    )


def content_integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document blocks compared and those whose text changed."""
    rows = before.select("doc_id", "block_id", "text").join(after.select("doc_id", "block_id", F.col("text").alias("now")), ["doc_id", "block_id"])
    changed = ~F.col("text").eqNullSafe(F.col("now"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("checked"), F.array_join(F.array_sort(F.collect_list(F.when(changed, F.col("block_id")))), ",").alias("corrupted"))


def stuck_documents(docs: DataFrame, now: str, k: int = 15) -> DataFrame:
    """Unfinished documents, the oldest update first (a top list)."""
    rows = docs.where(~F.col("status").isin("ready", "generated")).withColumn("age", age(now))
    return rows.orderBy(F.asc_nulls_first("updated_at"), "id").limit(k).select("id", "filename", "status", "age")


def recent_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key by (order, id)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def attention_points(docs: DataFrame, clarifications: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """Alerts that hold now, with their level and number."""
    rows = docs.withColumn("age", age(now))
    old, mid = count_where(F.col("age") >= ABANDON_DAYS), count_where((F.col("age") >= ATTENTION_DAYS) & (F.col("age") < ABANDON_DAYS))
    worst = pending_clarifications(clarifications).where("excessive")
    share = pipeline_share(docs)
    alerts = [
        rows.agg(F.lit("info").alias("level"), F.lit("abandoned").alias("point"), old.alias("n")),
        rows.agg(F.lit("warning").alias("level"), F.lit("unfinished").alias("point"), mid.alias("n")),
        worst.agg(F.lit("warning").alias("level"), F.lit("clarifications").alias("point"), F.count("*").alias("n")),
        share.select(F.lit("warning").alias("level"), F.lit("native_never_used").alias("point"), F.when(F.col("native") == 0, F.col("old")).otherwise(zero()).alias("n")),
        queue_health(jobs).select(F.lit("danger").alias("level"), F.lit("failed_jobs").alias("point"), F.col("failed").alias("n")),
    ]
    found = alerts[0]
    for more in alerts[1:]:
        found = found.unionByName(more)
    return found.where("n > 0")


def snapshot_ranks(snapshots: DataFrame, most: int = 30) -> DataFrame:
    """Snapshots (doc_id, id, created_at) with rank from the newest, whether it is the latest and whether it goes."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("created_at"), F.desc("id")))
    return snapshots.select("doc_id", "id", rank.cast("long").alias("rank")).select("*", (F.col("rank") == 1).alias("latest"), (F.col("rank") > most).alias("expired"))


def lock_state(locks: DataFrame, now: str, user_id: int, stale: int = 180) -> DataFrame:
    """Locks (doc_id, user_id, acquired_at): stale after three minutes, held by another while fresh."""
    seconds = F.unix_timestamp(at(now).cast("timestamp")) - F.unix_timestamp(F.col("acquired_at").cast("timestamp"))
    old = seconds > stale
    return locks.select("doc_id", old.alias("stale"), (~old & (F.col("user_id") != user_id)).alias("held_by_other"))


def retention_expired(files: DataFrame, now: str, hours: int = 72) -> DataFrame:
    """Files (id, modified_at) older than the retention."""
    return files.where(F.col("modified_at") < F.expr(f"timestamp_ntz'{now}' - make_dt_interval(0, {hours})")).select("id")


def erase_users(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table (with a column user_id) without the rows of the erased users (user_id)."""
    return {name: df.join(ids, "user_id", "left_anti") for name, df in tables.items()}


def chat_context(messages: DataFrame, last: int = 10, budget: int = 12_000) -> DataFrame:
    """Of a session's last messages the newest that fit a budget of bytes; the newest always stays; in order."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= last)
    used = F.sum(F.octet_length("content")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    over = F.max((F.col("used") > budget).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", used).withColumn("over", over)
    return rows.where((F.col("rank") == 1) | (F.col("over") == 0)).select("session_id", "turn", "role", F.col("used").cast("long").alias("bytes_from_newest"))


def attachment_budget(messages: DataFrame, most: int = 8000) -> DataFrame:
    """Texts cut where a session's running total passes the cap; later ones are null."""
    order = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("content")).over(order), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(most) - F.col("before"))
    return messages.withColumn("before", before).select(
        "session_id", "turn", F.when(left > 0, F.substring(F.col("content"), F.lit(1), left.cast("int"))).alias("kept")
    )
