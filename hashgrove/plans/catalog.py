"""Every registered query: one per operator, over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.functions import maps, text
from hashgrove.operators import (
    audit,
    groups,
    identity,
    impressions,
    licensing,
    lineage,
    nested,
    sketches,
    traffic,
    vitals,
)
from hashgrove.session import fresh_path, materialize
from hashgrove.sources import dated, manifest, markers, sharded, snapshots
from hashgrove.sources.tables import read_table
from hashgrove.sources.text import write_text
from hashgrove.sources.views import read_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPORT_DAY = "2024-01-30"
RETENTION_DAY = date(2001, 8, 1)
FIRST_DAY, LAST_DAY = date(2024, 1, 5), date(2024, 1, 9)
PARTS = 400
MARKER_FILES = 4
# shard 17 has no file, which the audits have to see
SHARDS = range(18)
LOST_DAY = date(2024, 1, 10)
SNAPSHOT_DAY = date(2024, 1, 15)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def rounded(value: Column | str, name: str | None = None, places: int = 4) -> Column:
    """Rounded for comparison between engines; adding 0.0 turns -0.0 into 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return (F.round(column, places) + F.lit(0.0)).alias(name or value)


# --- traffic -------------------------------------------------------------------------------------


@query
def remove_scrapers(spark, folder):
    kept = traffic.remove_scrapers(read_view(spark, folder, "tracking_events"))
    return kept.select("event_id", "first_party_id", "third_party_id")


@query
def scraper_ids(spark, folder):
    found = traffic.scraper_ids(read_view(spark, folder, "tracking_events"))
    return found.select("first_party_id", big("n_ids"))


# --- identity ------------------------------------------------------------------------------------


def _delta(spark, folder):
    return identity.expand_raw(read_view(spark, folder, "id_delta_raw"), "idls", "idl")


@query
def id_delta_expand(spark, folder):
    return _delta(spark, folder).select("seq", "email_hash", "idl")


@query
def id_delta_reduce(spark, folder):
    return identity.reduce_delta(_delta(spark, folder))


@query
def id_merge(spark, folder):
    return identity.merge_identities(
        read_view(spark, folder, "id_current"),
        identity.reduce_delta(_delta(spark, folder)),
        read_view(spark, folder, "id_oracle"),
    )


@query
def id_presence_counts(spark, folder):
    return id_merge(spark, folder).groupBy("presence").agg(F.count(F.lit(1)).alias("n"))


# --- impressions ---------------------------------------------------------------------------------


def _impressions(spark, folder):
    return read_view(spark, folder, "impressions")


def _deduped(spark, folder):
    return impressions.dedupe_impressions(_impressions(spark, folder))


@query
def dedupe_impressions(spark, folder):
    return _deduped(spark, folder).drop("ts")


@query
def broken_drop_keys(spark, folder):
    return impressions.broken_drop_keys(_deduped(spark, folder))


@query
def flag_broken_drops(spark, folder):
    # the flag needs the deduplicated rows more than once
    columns = ("impression_id", "is_broken_drop", "md5", "sh1", "sh2", "template_id", "placement_id")
    rows = materialize(_deduped(spark, folder).select(*columns), "deduped")
    return impressions.flag_broken_drops(rows).select("impression_id", "is_broken_drop")


@query
def ua_classes(spark, folder):
    return impressions.ua_classes(_impressions(spark, folder))


@query
def expected_profit(spark, folder):
    return _impressions(spark, folder).select(
        "impression_id", rounded(impressions.expected_profit(), "exp_profit", 8)
    )


@query
def category_defaults(spark, folder):
    return _impressions(spark, folder).select(
        "impression_id",
        impressions.pricing_category(F.col("pricing_type")).alias("pricing"),
        impressions.source_category(F.col("buyeruid_source")).alias("source"),
    )


# --- groups --------------------------------------------------------------------------------------


def _statistics(spark, folder, **options):
    return groups.impression_statistics(_deduped(spark, folder), **options)


def _fan_out_counts(spark, folder, dedupe_keys):
    # rows are counted before they are copied
    has_hash = F.when(F.col("email_hash").isNotNull(), F.lit(True)).alias("has_hash")
    cells = _deduped(spark, folder).groupBy("bidder_id", has_hash).agg(F.count(F.lit(1)).alias("rows"))
    copies = groups.fan_out_groups(cells, F.col("bidder_id"), F.col("has_hash"), dedupe_keys=dedupe_keys)
    return copies.groupBy("bidder", "grp").agg(F.sum("rows").alias("n"))


@query
def group_fanout(spark, folder):
    return _fan_out_counts(spark, folder, True)


@query
def group_fanout_literal(spark, folder):
    return _fan_out_counts(spark, folder, False)


@query
def group_fanout_no_all(spark, folder):
    stats = _statistics(spark, folder, no_all=True, no_all_rtb=True)
    return groups.mean_statistic(stats, "spend").select("bidder", "grp", "n")


@query
def group_moments(spark, folder):
    moments = groups.with_stddev(_statistics(spark, folder).moments)
    return moments.select("bidder", "grp", "measure", "n", rounded("mean"), rounded("stddev"))


@query
def group_sums(spark, folder):
    return _statistics(spark, folder).sums.select("bidder", "grp", "measure", big("total"))


@query
def group_proportions(spark, folder):
    stats = _statistics(spark, folder)
    rtb = groups.proportion_statistic(stats, "isRtb", "spend")
    clicks = groups.proportion_statistic(stats, "clicks", "spend")
    return rtb.unionByName(clicks).select("bidder", "grp", "measure", big("hits"), big("total"))


@query
def group_categories(spark, folder):
    return _statistics(spark, folder).categories.select("bidder", "grp", "measure", "value", big("n"))


@query
def group_categories_approx(spark, folder):
    stats = _statistics(spark, folder, approx=True)
    return stats.categories.select("bidder", "grp", "measure", "value", big("n"))


def _wide_value() -> Column:
    """Ten frequent values and a long tail of rare ones."""
    return F.when(F.col("l_quantity") <= 10, F.concat(F.lit("q"), F.col("l_quantity").cast("int"))).otherwise(F.concat(F.lit("o"), "l_orderkey"))


@query
def category_estimates(spark, folder):
    """Every value of a category of thousands with its count, and whether its sketched count is within the bound."""
    lines = read_table(spark, folder, "lineitem").withColumn("value", _wide_value())
    found = sketches.summarise(lines, {"flag": F.col("l_returnflag")}, {"order": F.col("value")})
    exact = materialize(lines.groupBy(F.col("l_returnflag").alias("flag"), "value").agg(F.count(F.lit(1)).alias("exact")), "exact")
    asked = sketches.estimates(found, exact.select("flag", F.lit("order").alias("category"), "value"))
    bound = F.col("exact") + sketches.EPS * F.col("total")
    within = asked.join(exact.hint("merge"), ["flag", "value"]).join(sketches.totals(found), ["flag", "category"])
    return within.select("flag", "value", F.col("exact").alias("n"), F.col("n").between(F.col("exact"), bound).alias("within"))


@query
def category_hitters(spark, folder):
    """The ten most frequent of thousands of values by the sketch, with their exact counts."""
    lines = read_table(spark, folder, "lineitem").withColumn("value", _wide_value())
    found = sketches.heavy_hitters(sketches.summarise(lines, {"flag": F.col("l_returnflag")}, {"order": F.col("value")}), 10)
    exact = lines.groupBy(F.col("l_returnflag").alias("flag"), "value").agg(F.count(F.lit(1)).alias("exact"))
    near = F.col("n") - F.col("exact")
    return found.join(exact.hint("merge"), ["flag", "value"]).select("flag", "value", F.col("exact").alias("n"), (near >= 0).alias("above"))


@query
def group_wide_categories(spark, folder):
    """The fifty most frequent of more values than that, for every group."""
    rows = _deduped(spark, folder)
    wide = {"users": F.concat_ws("-", F.col("template_id"), F.col("placement_id"), F.col("bidder_id"))}
    stats = groups.bidder_statistics(rows, F.col("bidder_id"), F.col("email_hash"), categories=wide)
    return stats.categories.select("bidder", "grp", "measure", "value", big("n"))


@query
def group_category_statistic(spark, folder):
    stats = _statistics(spark, folder)
    found = groups.category_statistic(stats, "deviceTypes", "spend")
    return found.select("bidder", "grp", "measure", "value", big("n"), big("total"))


@query
def group_pairs(spark, folder):
    pairs = groups.compare_groups(_statistics(spark, folder).moments)
    return pairs.select("bidder", "grp_a", "grp_b", "measure", rounded("diff"), rounded("z"))


@query
def group_vs_rest(spark, folder):
    rest = groups.compare_with_rest(_statistics(spark, folder))
    return rest.select("bidder", "grp", "measure", rounded("diff"), rounded("z"))


@query
def group_report(spark, folder):
    report = groups.group_report(_statistics(spark, folder), REPORT_DAY)

    def frequencies(column: str) -> list[Column]:
        values = F.map_values(F.col(column)["frequencies"])
        return [
            F.when(F.col(column).isNotNull(), F.size(values)).cast("bigint").alias(f"{column}_values"),
            F.aggregate(values, F.lit(0).cast("bigint"), lambda s, n: s + n).alias(f"{column}_rows"),
        ]

    flat = report.select(
        "date",
        "definition.*",
        *[
            c
            for m in ("spend", "clearingPrice", "expectedProfit")
            for c in (
                F.col(m)["n"].alias(f"{m}_n"),
                rounded(F.col(m)["mean"], f"{m}_mean"),
                rounded(F.col(m)["stddev"], f"{m}_stddev"),
            )
        ],
        *[
            c
            for p in ("rtbWins", "clicks")
            for c in (F.col(p)["count"].alias(f"{p}_count"), F.col(p)["total"].alias(f"{p}_total"))
        ],
        *[c for k in ("sources", "pricingTypes", "oss", "browsers") for c in frequencies(k)],
    )
    return groups.order_by_group(flat)


# --- licensing -----------------------------------------------------------------------------------


def _licenses(spark, folder):
    return read_view(spark, folder, "identifier_info"), read_view(spark, folder, "license_info")


def _lacking_licenses(spark, folder):
    return read_view(spark, folder, "identifier_info"), read_view(spark, folder, "license_info_lacking")


TOTALS = ("identifiers", "opens", "clicks", "conversions")


@query
def partner_totals(spark, folder):
    found = licensing.partner_totals(*_licenses(spark, folder))
    return found.select("partner", *[big(c) for c in TOTALS])


@query
def partner_overlap(spark, folder):
    found = licensing.partner_overlap(*_licenses(spark, folder))
    return found.select("partners", *[big(c) for c in TOTALS])


@query
def partner_coverage(spark, folder):
    found = licensing.partner_coverage(*_licenses(spark, folder))
    return found.select("subset", *[big(c) for c in TOTALS])


@query
def partner_lift(spark, folder):
    found = licensing.partner_lift(*_licenses(spark, folder))
    return found.select(
        "subset",
        *[big(f"{c}_change") for c in TOTALS],
        *[rounded(f"{c}_share") for c in TOTALS],
    )


# twelve partners that each have some suppliers' parts
MANY_PARTNERS = {f"L{i}": f"P{i:02d}" for i in range(12)}


def _many_licenses(spark, folder):
    info = read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("identifier"), F.col("p_size").alias("opens"), F.lit(1).alias("clicks"), F.lit(0).alias("conversions")
    )
    code = F.concat(F.lit("L"), (F.col("l_suppkey") + F.col("l_partkey") % 3) % 12)
    return info, read_table(spark, folder, "lineitem").where("l_quantity <= 9").select(F.col("l_partkey").alias("identifier"), code.alias("license"))


@query
def partner_lattice(spark, folder):
    """Coverage of every choice among twelve partners."""
    found = licensing.partner_coverage(*_many_licenses(spark, folder), MANY_PARTNERS)
    return found.select("subset", *[big(c) for c in TOTALS])


@query
def partner_overlap_approx(spark, folder):
    """Coverage of every choice of partners, and whether the sketched one is within four standard errors of the known identifiers."""
    info, owned = _lacking_licenses(spark, folder)
    exact = licensing.partner_coverage(info, owned).select("subset", big("identifiers"))
    guess = licensing.partner_overlap_approx(info, owned).withColumnRenamed("identifiers", "guess")
    either = info.select("identifier").union(owned.select("identifier")).distinct().count()
    return exact.join(guess, "subset").select("subset", "identifiers", (F.abs(F.col("guess") - F.col("identifiers")) <= 4 * either / 2**7).alias("within"))


@query
def unlicensed(spark, folder):
    return licensing.unlicensed(*_lacking_licenses(spark, folder))


@query
def unmapped_codes(spark, folder):
    return licensing.unmapped_codes(read_view(spark, folder, "license_info"))


# --- audit ---------------------------------------------------------------------------------------


def _files(spark, folder):
    return read_view(spark, folder, "marker_files")


@query
def shard_completeness(spark, folder):
    found = audit.shard_completeness(_files(spark, folder), SHARDS, PARTS)
    return found.select("path_shard", "files", "bytes", "parts", big("missing"), "complete")


@query
def missing_parts(spark, folder):
    return audit.missing_parts(_files(spark, folder), SHARDS, PARTS)


@query
def cross_shard_commits(spark, folder):
    return audit.cross_shard_commits(_files(spark, folder))


@query
def job_id_collisions(spark, folder):
    return audit.job_id_collisions(_files(spark, folder))


@query
def overlapping_windows(spark, folder):
    return audit.overlapping_windows(read_view(spark, folder, "commit_spans"))


@query
def declared_against_listed(spark, folder):
    # marker documents as a job leaves them: a map of metrics and the list of its files
    rows = read_view(spark, folder, "marker_documents")
    documents = rows.select(
        "shard",
        F.lit(0).cast("bigint").alias("timestamp"),
        F.lit("Task committer attempt_20210227000000_0000_m_000000_0").alias("description"),
        F.create_map(
            F.lit("committer_commits_completed"), "declared", F.lit("committer_bytes_committed"), "bytes"
        ).alias("metrics"),
        F.transform(F.sequence(F.lit(1), F.col("listed")), lambda i: F.concat(F.lit("part-r-"), i)).alias("filenames"),
    )
    found = audit.declared_against_listed(markers.marker_summary(documents), MARKER_FILES)
    return found.select("committed_by", "declared", "listed", "bytes")


@query
def file_names(spark, folder):
    parsed = markers.parse_file_names(read_view(spark, folder, "file_names"))
    return parsed.select("id", "path_shard", "path_day", "part_no", "job_id", "codec")


@query
def commit_windows(spark, folder):
    day = F.to_date("o_orderdate")
    commits = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.unix_date(day).cast("bigint") * 86400000 + F.floor("o_totalprice") * 1000).alias("timestamp"),
        F.concat(
            F.lit("Task committer attempt_"),
            F.date_format(day, "yyyyMMdd"),
            F.lit("000000_0000_m_000000_0"),
        ).alias("description"),
    )
    return markers.with_commit_window(commits).select("id", "elapsed_s")


@query
def metric_spread(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    documents = lines.select(
        (F.col("l_suppkey") % 17).alias("shard"),
        F.create_map(
            F.lit("files quantity (n)"),
            F.col("l_quantity").cast("bigint"),
            F.lit("bytes price (n)"),
            F.floor("l_extendedprice"),
        ).alias("metrics"),
    )
    spread = audit.metric_spread(markers.marker_metrics(documents))
    return spread.select("metric", "n", "least", "greatest", rounded("mean"))


@query
def retention_plan(spark, folder):
    plan = audit.retention_plan(read_table(spark, folder, "orders"), "o_orderdate", RETENTION_DAY)
    return plan.select(F.col("day").cast("string").alias("day"), "keep")


def _volume(spark, folder):
    # one kind of event has no rows on one day: its rows of that day are dated a day later
    lost = (F.col("event_type") == "error") & (F.to_date("ts") == F.lit(LOST_DAY))
    day = F.when(lost, F.date_add(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))
    return audit.daily_volume(read_table(spark, folder, "events").withColumn("day", day), "event_type", "day")


@query
def daily_volume(spark, folder):
    return _volume(spark, folder).withColumn("day", F.col("day").cast("string"))


@query
def volume_drop(spark, folder):
    found = audit.volume_drop(_volume(spark, folder))
    return found.select("entity", F.col("day").cast("string").alias("day"), "n", rounded("ratio"), "dropped")


@query
def daily_anomaly(spark, folder):
    found = audit.daily_anomaly(_volume(spark, folder))
    return found.select("entity", F.col("day").cast("string").alias("day"), "n", rounded("z"))


@query
def input_readiness(spark, folder):
    return markers.input_readiness(
        read_view(spark, folder, "required_inputs"), read_view(spark, folder, "listed_markers")
    )


@query
def snapshot_cycle(spark, folder):
    root = fresh_path(spark, "snapshots")
    feeds = identity.feed_interval((SNAPSHOT_DAY - timedelta(days=1), SNAPSHOT_DAY))
    read_view(spark, folder, "id_current").write.parquet(dated.day_folder(root, feeds[1]))
    delta = identity.reduce_delta(_delta(spark, folder))
    identity.update_snapshot(spark, root, SNAPSHOT_DAY, delta, read_view(spark, folder, "id_oracle"))
    return dated.read_day(spark, root, SNAPSHOT_DAY)


@query
def snapshot_buckets(spark, folder):
    """A bucketed snapshot merged with a day's feeds, and on the next day with empty ones."""
    root = fresh_path(spark, "snapshots")
    delta, oracle = identity.reduce_delta(_delta(spark, folder)), read_view(spark, folder, "id_oracle")
    current = read_view(spark, folder, "id_current").select("email_hash", "idl", "oracle_id")
    snapshots.write_bucketed(current, dated.day_folder(root, SNAPSHOT_DAY - timedelta(days=1)), "email_hash", buckets=8)
    snapshots.merge_day(spark, root, SNAPSHOT_DAY, delta, oracle, buckets=8)
    next_day = SNAPSHOT_DAY + timedelta(days=1)
    snapshots.merge_day(spark, root, next_day, delta.limit(0), oracle.limit(0), buckets=8)
    return snapshots.read_snapshot(spark, dated.day_folder(root, next_day), current.schema)


@query
def scrapers_by_day(spark, folder):
    """Traffic without scrapers, found by a state that a third of the month's days is merged into at a time."""
    root = fresh_path(spark, "scrapers")
    events = read_view(spark, folder, "tracking_events").withColumn("day", F.to_date("ts"))
    for third in range(3):
        part = events.where(F.pmod(F.dayofmonth("day"), 3) == third)
        state = snapshots.merge_state(spark, root, SNAPSHOT_DAY + timedelta(days=third), traffic.day_ids(part), "first_party_id", "least", "greatest", buckets=8)
    kept = traffic.remove_known(events, materialize(traffic.known_scrapers(state), "scrapers"))
    return kept.select("event_id", "first_party_id", "third_party_id")


@query
def marker_cycle(spark, folder):
    """Days written and marked complete, their markers listed, and jobs gated by them."""
    root = f"{fresh_path(spark, 'marked')}/events"
    events = _dated_events(spark, folder).select("event_id", "event_type", "date")
    span = events.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    days = [span["first"] + timedelta(days=i) for i in range((span["last"] - span["first"]).days + 1)]
    dated.write_dated(events, root, [d for d in days if d.day % 7], files_per_day=1)
    required = spark.read.parquet(root).select(
        F.col("event_type").alias("job"), F.lit("events").alias("input"), F.date_format("date", "yyyyMMdd").alias("day")
    )
    listed = markers.listed_inputs(spark, f"{root}/date=*/_SUCCESS")
    return markers.input_readiness(required.distinct(), listed)


def _committed_events(spark, folder, root, **how):
    """All days but one committed below ``root``; that one's write is killed half way."""
    events = read_table(spark, folder, "events").select(
        text.hex_shard(F.md5(F.col("user_id").cast("string"))).alias("shard"), F.to_date("ts").alias("day"), "event_id", "event_type"
    )
    kept, lost = events.where(F.col("day") != F.lit(LOST_DAY)), events.where(F.col("day") == F.lit(LOST_DAY))
    manifest.write_committed(kept, root, "shard", "day", separator="|", part=F.col("event_id") % 3, **how)
    died = F.when(F.col("event_id") % 2 == 0, F.raise_error(F.lit("killed half way"))).otherwise(F.col("event_type"))
    try:
        manifest.write_committed(lost.withColumn("event_type", died), root, "shard", "day", separator="|", part=F.col("event_id") % 3)
    except PySparkException as error:
        if "killed half way" not in str(error):
            raise
    return events


@query
def manifest_write(spark, folder):
    """Files, rows and bytes that the markers of a committed write declare, and the number of files they list."""
    root = fresh_path(spark, "manifest")
    _committed_events(spark, folder, root, codec="zst")
    found = manifest.read_manifests(spark, root)
    metric = F.col("metrics")
    return found.select(
        "shard",
        "day",
        metric["committer_commits_completed"].alias("declared"),
        F.size("filenames").cast("bigint").alias("listed"),
        metric["records_written"].alias("records"),
        metric["stream_write_total_data"].alias("raw_bytes"),
    )


@query
def manifest_audit(spark, folder):
    """The audits of committed output on markers that the sink wrote: lost folders and parts, foreign commits, shared job ids, counts."""
    root = fresh_path(spark, "manifest")
    events = _committed_events(spark, folder, root, codec="txt")
    found = manifest.read_manifests(spark, root).withColumn("shard", F.concat_ws("/", "shard", "day"))
    files = markers.marker_files(materialize(found, "manifests"))
    files = files.withColumn("path_shard", F.concat_ws("/", "path_shard", "path_day"))
    # folders that the table must have: one for each shard and day
    wanted = [r["place"] for r in events.select(F.concat_ws("/", "shard", F.date_format("day", "yyyyMMdd")).alias("place")).distinct().collect()]
    one = F.count(F.lit(1)).alias("n")
    checks = [
        audit.missing_parts(files, wanted, 3).groupBy(F.lit("missing part").alias("what"), F.col("path_shard").alias("place")).agg(one),
        audit.cross_shard_commits(files).select(F.lit("foreign file").alias("what"), F.col("path_shard").alias("place"), F.col("files").alias("n")),
        audit.job_id_collisions(files).select(F.lit("shared job").alias("what"), F.lit("all").alias("place"), F.col("shards").alias("n")),
        audit.declared_against_listed(markers.marker_summary(found), 3).select(F.lit("uneven").alias("what"), F.col("committed_by").alias("place"), F.col("listed").alias("n")),
    ]
    return reduce(DataFrame.unionByName, checks)


@query
def manifest_scan(spark, folder):
    """Markers of some days and shards; the others are not opened."""
    root = fresh_path(spark, "manifest")
    _committed_events(spark, folder, root, codec="txt")
    asked = (F.col("day") >= f"{FIRST_DAY:%Y%m%d}") & (F.col("day") <= f"{LOST_DAY:%Y%m%d}") & F.col("shard").isin("0", "7", "a", "s")
    return manifest.read_manifests(spark, root).where(asked).select("shard", "day", F.col("metrics")["records_written"].alias("records"))


@query
def manifest_replace(spark, folder):
    """Lines of a committed dataset after one day was written again with other rows."""
    root = fresh_path(spark, "manifest")
    events = _committed_events(spark, folder, root)
    again = events.where(F.col("day") == F.lit(LAST_DAY)).withColumn("event_type", F.lit("again"))
    manifest.write_committed(again, root, "shard", "day", files_per_folder=2, separator="|", replace=True)
    fields = F.split("value", r"\|")
    lines = manifest.read_committed(manifest.read_manifests(spark, root))
    return lines.select("shard", "day", fields[0].cast("bigint").alias("event_id"), fields[1].alias("event_type"))


@query
def single_file(spark, folder):
    path = fresh_path(spark, "single")
    counts = read_table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    write_text(counts, path, separator="|", single_file=True)
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    n_files = lines.agg(F.count_distinct("file").alias("files")).scalar()
    return lines.select("value", n_files.alias("files"))


@query
def nonempty_groups(spark, folder):
    groups_of = _impressions(spark, folder).select(F.coalesce("buyeruid_source", F.lit("")).alias("group"))
    return groups.drop_empty_group(groups_of, "group").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query
def sorted_edges(spark, folder):
    return lineage.sorted_edges(_edges(spark, folder))


@query
def first_listed_day(spark, folder):
    events = _dated_events(spark, folder)
    return dated.head_of_days(events, FIRST_DAY, LAST_DAY).select(F.col("date").cast("string").alias("day"))


@query
def running_tasks(spark, folder):
    return audit.running_tasks(read_view(spark, folder, "task_instance"))


# --- sources and sinks ---------------------------------------------------------------------------


def _dated_events(spark, folder):
    return read_table(spark, folder, "events").withColumn("date", F.to_date("ts"))


@query
def dated_read(spark, folder):
    root = fresh_path(spark, "dated")
    dated.write_dated(_dated_events(spark, folder), root)
    days = dated.read_dated(spark, root, FIRST_DAY, LAST_DAY)
    return days.select("event_id", "user_id", F.col("date").cast("string").alias("day"))


@query
def text_sink(spark, folder):
    path = fresh_path(spark, "lines")
    orders = read_table(spark, folder, "orders")
    write_text(
        orders.select("o_orderkey", "o_custkey", "o_orderpriority"), path, compression="gzip", separator="|"
    )
    return spark.read.text(path)


@query
def keyed_sink(spark, folder):
    path = fresh_path(spark, "keyed")
    orders = read_table(spark, folder, "orders")
    write_text(orders.select("o_orderstatus", "o_orderkey"), path, partition_by="o_orderstatus", separator="|")
    return spark.read.text(path).select("o_orderstatus", "value")


@query
def sharded_write(spark, folder):
    root = fresh_path(spark, "sharded")
    rows = read_table(spark, folder, "events").select(
        F.md5(F.col("user_id").cast("string")).alias("key"),
        "event_id",
        F.to_date(F.date_trunc("week", "ts")).alias("date"),
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded.write_sharded(rows, root, "key", tasks, files_per_shard=4)
    written = spark.read.parquet(root)
    return written.groupBy(
        F.col("shard").cast("string").alias("shard"), F.col("date").cast("string").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query
def shard_layout(spark, folder):
    customers = read_table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("x"), F.col("c_name")))
        .otherwise(F.md5(F.col("c_custkey").cast("string")))
        .alias("key")
    )
    return sharded.with_shard(customers, "key").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


# --- maps and sizes ------------------------------------------------------------------------------


def _type_counts(events: DataFrame, parity: int, name: str) -> DataFrame:
    # a map has at most as many entries as there are event types
    counts = events.groupBy("user_id", "event_type").agg(
        F.count_if(F.col("event_id") % 2 == parity).alias("n")
    )
    pair = F.when(F.col("n") > 0, F.struct("event_type", "n"))
    return counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(pair)).alias(name))


@query
def map_merge(spark, folder):
    events = read_table(spark, folder, "events")
    sides = _type_counts(events, 0, "m1").join(_type_counts(events, 1, "m2"), "user_id")
    merged = maps.map_merge(F.col("m1"), F.col("m2"), lambda a, b: a - b)
    return sides.select("user_id", F.explode(merged).alias("map_key", "value"))


def _props(spark, folder):
    events = read_table(spark, folder, "events")
    return events.select("event_id", "user_id", F.from_json("props", "map<string,bigint>").alias("m"))


@query
def map_merge_agg(spark, folder):
    return nested.map_merge_agg(_props(spark, folder), ["user_id"], "m", F.sum)


@query
def json_maps(spark, folder):
    return _props(spark, folder).select("event_id", F.explode("m").alias("map_key", "value"))


@query
def map_union_strict(spark, folder):
    sides = _props(spark, folder).withColumn(
        "other", F.create_map(F.lit("user"), F.col("user_id"))
    )
    united = maps.map_union_strict(F.col("m"), F.col("other"))
    return sides.select("event_id", F.explode(united).alias("map_key", "value"))


@query
def size_estimate(spark, folder):
    return nested.with_size(read_table(spark, folder, "documents")).select("doc_id", "bytes")


@query
def size_estimate_arrays(spark, folder):
    return nested.with_size(read_table(spark, folder, "embeddings")).select("vec_id", "bytes")


@query
def size_by_column(spark, folder):
    return nested.size_by_column(read_table(spark, folder, "documents"))


@query
def size_outliers(spark, folder):
    found = nested.size_outliers(read_table(spark, folder, "documents"), "doc_id", "lang")
    return found.select("lang", "doc_id", "bytes", rounded("bound"), big("rank"))


# --- dependency tables ---------------------------------------------------------------------------


def _edges(spark, folder):
    return read_view(spark, folder, "dependency_edges")


@query
def edge_build(spark, folder):
    declarations = read_view(spark, folder, "declarations")
    lines = declarations.where("side = 'from'").select("task")
    return (
        lineage.build_edges(declarations)
        .unionByName(lineage.root_edges(lines, "create_cluster"))
        .unionByName(lineage.final_edges(lines, ["check_running", "terminate_cluster"]))
    )


@query
def set_ops(spark, folder):
    edges = _edges(spark, folder)
    ok, not_ok = edges.where("mode = 'ok'"), edges.where("mode = 'not_ok'")
    bag = lineage.bag_union(ok, not_ok).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    result = bag.select(F.lit("bag").alias("op"), "src", "dst", "n")
    for name, op in (
        ("union", lineage.edge_union),
        ("intersection", lineage.edge_intersection),
        ("difference", lineage.edge_difference),
    ):
        one = F.lit(1).cast("bigint").alias("n")
        result = result.unionByName(op(ok, not_ok).select(F.lit(name).alias("op"), "src", "dst", one))
    return result


@query
def closure(spark, folder):
    return lineage.closure(_edges(spark, folder))


@query
def reduction(spark, folder):
    return lineage.reduction(_edges(spark, folder))


@query
def cycles(spark, folder):
    return lineage.cycles(read_view(spark, folder, "cyclic_edges"))


@query
def trigger_rules(spark, folder):
    return lineage.trigger_rules(_edges(spark, folder))


@query
def trigger_conflicts(spark, folder):
    return lineage.trigger_conflicts(_edges(spark, folder))


@query
def label_spread(spark, folder):
    return lineage.spread_label(read_view(spark, folder, "line_declarations"), read_view(spark, folder, "label_seeds"))


@query
def ready_tasks(spark, folder):
    return lineage.ready_tasks(_edges(spark, folder), read_view(spark, folder, "done_tasks"))


@query
def clean_names(spark, folder):
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), text.clean_name(F.col("c_name")).alias("name")
    )


@query
def dotted_tail(spark, folder):
    return read_table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), text.dotted_tail(F.col("url")).alias("tail")
    )


@query
def path_labels(spark, folder):
    return read_view(spark, folder, "path_templates").select(
        F.col("page_id").alias("id"),
        text.path_label(F.col("template"), drop=("blog.",)).alias("label"),
    )


# --- vitals --------------------------------------------------------------------------------------


@query
def person_day(spark, folder):
    days = vitals.person_day(read_view(spark, folder, "vitals"))
    return days.select(
        "person_id",
        F.col("day").cast("string").alias("day"),
        "readings",
        *[rounded(f"{r}_mean", places=10) for r in vitals.READINGS],
        *[f"{r}_missing" for r in vitals.READINGS],
        rounded("body_temperature_max", places=10),
    )


@query
def baseline_deviation(spark, folder):
    found = vitals.baseline_deviation(read_view(spark, folder, "vitals"))
    return found.select(
        "person_id", F.col("day").cast("string").alias("day"), rounded("temperature", places=10), rounded("deviation", places=10)
    )


@query
def location_rate(spark, folder):
    found = vitals.location_rate(read_view(spark, folder, "vitals"))
    return found.select("location", F.col("day").cast("string").alias("day"), "persons", rounded("rate"))


@query
def confirmed_classifier(spark, folder):
    # scores depend on the solver and are tested apart; inputs, labels and the split are exact
    scores, _ = vitals.confirmed_classifier(read_view(spark, folder, "vitals"))
    scored = F.col("score").between(0, 1).alias("scored")
    return scores.select("person_id", "label", "train", scored, *[rounded(r, places=8) for r in vitals.READINGS])
