"""The operations ledger: log metrics, time per stage, interruptions, stalls, tickets, source scores, transfers, scores of
extractors, and what scans may skip."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pages import AMBIGUOUS, bare
from ..functions.stats import half_up

# What the logs of the scans, the study and the replication say.
SUMMARY = r"(?s)scannées\s*:\s*(\d+).*?nouvelles\s*:\s*(\d+).*?changées\s*:\s*(\d+).*?retirées\s*:\s*(\d+)"
SNAPSHOT = r"snapshot\s*:\s*(\S+)"
REPORT = r"rapport\s*:\s*(\S+)"
ARCHIVED = r":\s*(\d+)\s+lignes serveur\s*→\s*(\d+)\s+en archive"
PURGED = r"(\d+)\s+annonces purgées"
PURGE_REFUSED = r"purge ANNULÉE|purge interdite"
HTTP_ERRORS = r"(?i)HTTP\s*(?:error\s*)?(4\d\d|5\d\d)"
IMAGE_ERRORS = r"(?iu)upload erreur|échec GET \(bytes\)|echec GET \(bytes\)|erreur image"
TRACEBACKS = r"(?i)traceback|\[erreur\]"
OUTAGE_MARKS = ("ConnectionError", "Max retries exceeded", "Name or service not known")
TAIL, LEAST_MARKS, STALL_MINUTES = 20_000, 3, 10


@dataclass(frozen=True)
class LogWords:
    """The patterns by which log_metrics() reads a log; SUMMARY and ARCHIVED have a group for each figure."""

    summary: str = SUMMARY
    snapshot: str = SNAPSHOT
    report: str = REPORT
    archived: str = ARCHIVED
    purged: str = PURGED
    purge_refused: str = PURGE_REFUSED
    http_errors: str = HTTP_ERRORS
    image_errors: str = IMAGE_ERRORS
    tracebacks: str = TRACEBACKS


def log_metrics(logs: DataFrame, text: str = "text", words: LogWords = LogWords()) -> DataFrame:
    """`logs` plus the figures that their text states; absent ones null, counted ones 0.

    The four figures of a scan count only where all stand in its summary, in their order. A purge that was refused is
    one of no rows, and purge_refused is then true, else null.
    """
    body = F.col(text)
    found = lambda p, i=1: F.when(F.regexp_extract(body, p, i) != "", F.regexp_extract(body, p, i))
    columns = {k: found(words.summary, i + 1).cast("long") for i, k in enumerate(("scanned", "new", "changed", "removed"))}
    columns |= {"snapshot": found(words.snapshot), "report": found(words.report)}
    counts = F.regexp_extract_all(body, F.lit(words.archived), F.lit(2))
    columns["tables"] = F.when(F.size(counts) > 0, F.size(counts).cast("long"))
    columns["archived"] = F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))
    purged = found(words.purged).cast("long")
    refused = purged.isNull() & body.rlike(words.purge_refused)
    columns |= {"purged": F.when(refused, 0).otherwise(purged), "purge_refused": F.when(refused, True)}
    columns |= {k: F.regexp_count(body, F.lit(p)).cast("long") for k, p in (("http_errors", words.http_errors), ("image_errors", words.image_errors), ("tracebacks", words.tracebacks), ("lines", r"\n"))}
    return logs.select("*", *[v.alias(k) for k, v in columns.items()])


def outage(text: Column) -> Column:
    """Whether the end of a log names network failures three times."""
    tail = F.substr(text, F.greatest(F.length(text) - TAIL + 1, F.lit(1)))
    hits = reduce(lambda a, b: a + b, [F.size(F.split(tail, m)) - 1 for m in OUTAGE_MARKS])
    return hits >= LEAST_MARKS


def stage_times(times: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, stage, seconds, calls, share_pct): a row for each stage of a run and one, unmeasured, for what is in none.

    times: (run, stage, seconds); runs: (run, seconds).
    """
    per = times.groupBy("run", "stage").agg(F.sum("seconds").alias("s"), F.count("*").alias("calls"))
    rest = runs.join(per.groupBy("run").agg(F.sum("s").alias("known")), "run", "left")
    rest = rest.select("run", F.lit("unmeasured").alias("stage"), F.greatest(F.lit(0.0), F.col("seconds") - F.coalesce("known", F.lit(0.0))).alias("s"), F.lit(0).cast("long").alias("calls"))
    out = per.union(rest).join(runs.select("run", F.col("seconds").alias("whole")), "run")
    return out.select("run", "stage", half_up(F.col("s"), 1).alias("seconds"), "calls", (F.floor(F.col("s") * 1000 / F.greatest(F.col("whole"), F.lit(1e-9)) + 0.5) / 10).alias("share_pct"))


def interrupted_by(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Interrupted runs in whose time, up to now if it has no end, an event (at) fell. Both meet by the day."""
    r = runs.where("status = 'interrupted'").withColumn("__end", F.coalesce("ended_at", F.current_timestamp().cast(runs.schema["ended_at"].dataType)))
    r = r.withColumn("__day", F.explode(F.sequence(F.to_date("started_at"), F.to_date("__end"))))
    e = events.select(F.col("at").alias("__at"), F.to_date("at").alias("__on"))
    inside = (F.col("__day") == F.col("__on")) & (F.col("__at") >= F.col("started_at")) & (F.col("__at") <= F.col("__end"))
    return r.join(e, inside, "left_semi").drop("__day", "__end").distinct()


def stalled(rows: DataFrame, key: str, at: str, as_of: Column, minutes: int = STALL_MINUTES) -> DataFrame:
    """(key, last, stalled): whether nothing new came for `minutes`."""
    out = rows.groupBy(key).agg(F.max(at).alias("last"))
    return out.withColumn("stalled", F.col("last") < as_of - F.expr(f"interval {minutes} minutes"))


def converged_runs(attempts: DataFrame, expected: DataFrame) -> DataFrame:
    """(source, attempt, n, gain, done, reason) of crawls (source, attempt, n, exit_code, outage).

    Done are those that ended well with enough rows, or from the second attempt on with a gain under 20 rows and 2 %.
    expected: (source, expected).
    """
    w = W.partitionBy("source").orderBy("attempt")
    rows = attempts.join(expected, "source", "left").withColumn("gain", F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0)))
    enough = F.coalesce(F.col("n") >= F.col("expected"), F.lit(False))
    settled = (F.col("attempt") >= 2) & (F.col("gain") < F.greatest(F.lit(20), F.floor(F.greatest(F.col("n"), F.lit(1)) * 0.02)))
    well = (F.col("exit_code") == 0) & ~F.col("outage")
    reason = F.when(well & enough, "enough").when(well & settled, "converged").when(F.col("outage"), "outage").when(~enough, "volume").otherwise("exit code")
    return rows.select("source", "attempt", "n", "gain", (well & (enough | settled)).alias("done"), reason.alias("reason"))


def backup_state(expected: DataFrame, archive: DataFrame, live: DataFrame, runs: DataFrame, as_of: Column, ratio: float = 0.9, cadence: int = 7, margin: int = 1) -> DataFrame:
    """One row: missing (tables), ratio of archived to live listings, age_days of the last good run, catch_up, reasons.

    expected: (name); archive: (name, n); live: (n), null or empty if unknown, which passes; runs: (status, started_at).
    """
    missing = expected.join(archive, "name", "left_anti").agg(F.array_sort(F.collect_list("name")).alias("missing"))
    kept = archive.where("name = 'listings'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    now = live.agg(F.max("n").alias("live"))
    last = runs.where("status = 'ok'").agg(F.max("started_at").alias("last"))
    row = missing.join(F.broadcast(kept)).join(F.broadcast(now)).join(F.broadcast(last))  # one row each
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400e6
    row = row.select("missing", "kept", (F.col("kept") / F.when(F.col("live") > 0, F.col("live"))).alias("ratio"), age.alias("age_days"))
    reasons = F.array_compact(F.array(
        F.when(F.size("missing") > 0, F.concat(F.lit("missing tables: "), F.array_join("missing", ", "))), F.when(F.col("kept") == 0, "no listings archived"),
        F.when(F.col("ratio") < ratio, "archive short of the live rows"), F.when(F.col("age_days").isNull(), "no good backup"), F.when(F.col("age_days") > cadence + margin, "backup too old"),
    ))
    return row.withColumn("reasons", reasons).withColumn("catch_up", F.size("reasons") > 0).drop("kept")


def tickets(escalations: DataFrame) -> DataFrame:
    """Adds `ticket` to (agent, kind, created_at, id): second, agent and kind, and from the second of a name on its number."""
    stem = F.concat_ws("-", F.date_format("created_at", "yyyy-MM-dd'T'HHmmss"), "agent", "kind")
    rows = escalations.withColumn("__stem", stem)
    n = F.row_number().over(W.partitionBy("__stem").orderBy("created_at", "id"))
    return rows.withColumn("ticket", F.concat("__stem", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".json"))).drop("__stem")


def queue(opened: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pending tickets in the order of their names. resolved: (ticket, resolution, resolved_at)."""
    return opened.join(resolved, "ticket", "left_anti").orderBy("ticket")


def source_scores(probes: DataFrame, before: DataFrame, least_links: int = 20) -> DataFrame:
    """(name, blob, links, promising, note) of candidate sites (name, http, html, permissive); notes are carried over
    from an earlier round (name, note)."""
    html = F.coalesce("html", F.lit(""))
    blob = (
        F.when(F.contains(html, F.lit("__NEXT_DATA__")), "__NEXT_DATA__").when(html.rlike(r"""type=["']application/ld\+json"""), "ld+json")
        .when(F.contains(html, F.lit("window.__NUXT__")), "__NUXT__")
    )
    links = F.size(F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*(?:condo|property|listing)[^"]*)"'), F.lit(1))))
    rows = probes.select("name", "http", "permissive", blob.alias("blob"), links.alias("links")).join(before.select("name", "note"), "name", "left")
    good = (F.col("http") == 200) & F.col("blob").isNotNull() & (F.col("links") >= least_links) & F.col("permissive")
    return rows.select("name", "blob", "links", F.coalesce(good, F.lit(False)).alias("promising"), "note")


def transferred(rows: DataFrame) -> DataFrame:
    """Rows of the local store as the server has them: JSON texts parsed (bad ones are an empty object or null), 0 and 1
    as booleans, no amenities and images."""
    return rows.withColumns({
        "raw_data": F.when(F.col("raw_data").isNotNull(), F.coalesce(F.try_parse_json("raw_data"), F.parse_json(F.lit("{}")))),
        "is_auto_repost": F.col("is_auto_repost") != 0, "photo_sizes": F.from_json(F.when(F.try_parse_json("photo_sizes").isNotNull(), F.col("photo_sizes")), "array<bigint>"),
        "amenities": F.array().cast("array<string>"), "image_urls": F.array().cast("array<string>"),
    })


def without_province(stubs: DataFrame, province: str = "bangkok") -> DataFrame:
    """Stubs (place, url, full_address) of one province, each URL once without its query, the first of the list."""
    rows = stubs.where(F.endswith(F.lower(F.coalesce("full_address", F.lit(""))), F.lit(province))).withColumn("url", bare(F.col("url"))).where("url <> ''")
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("url").orderBy("place"))).where("__r = 1").drop("__r")


def to_visit(stubs: DataFrame, state: DataFrame, images: DataFrame) -> DataFrame:
    """Adds `known` to (id, price): a listing that is there at the same price and with an image is only touched."""
    has = images.select(F.col("listing_id").alias("id")).distinct().withColumn("__image", F.lit(True))
    old = state.select("id", F.col("price").alias("__price"))
    out = stubs.join(old, "id", "left").join(has, "id", "left")
    return out.withColumn("known", F.coalesce((F.col("price") == F.col("__price")) & F.col("__image"), F.lit(False))).drop("__price", "__image")


def secondary_images(images: DataFrame) -> DataFrame:
    """Images behind the first of their listing, which may be pruned."""
    return images.where("ord >= 1")


def polluted(text: Column) -> Column:
    """Whether a description holds code or the brand's own text."""
    return F.coalesce(text.like("%{%:%;%") | text.like("%function(%") | F.lower(text).like("%most popular property website%"), F.lit(False))


def extractor_scores(rows: DataFrame, fields: dict[str, str], same=None) -> DataFrame:
    """(field, n_firm, correct_pct, n_ambiguous, abstained_pct, n_absent, silent_pct): an extractor on three populations.

    rows: for each field `got_<field>` and `want_<field>`. Where the wanted value is AMBIGUOUS, being ambiguous or silent
    is right; where there is none, only silence. fields: how a field is compared, "equal" or "company".
    """
    from ..functions.pages import same_company

    out = None
    for field, how in fields.items():
        got, want = F.col(f"got_{field}").cast("string"), F.col(f"want_{field}").cast("string")
        torn, none = F.coalesce(want == AMBIGUOUS, F.lit(False)), want.isNull()
        firm = ~torn & ~none
        right = same_company(got, want) if how == "company" else got.eqNullSafe(want)
        count = lambda c: F.count(F.when(c, 1))
        pct = lambda c, of: half_up(count(of & c) / F.when(count(of) > 0, count(of)) * 100, 1)
        one = rows.agg(
            F.lit(field).alias("field"), count(firm).alias("n_firm"), pct(right, firm).alias("correct_pct"), count(torn).alias("n_ambiguous"),
            pct(got.isNull() | (got == AMBIGUOUS), torn).alias("abstained_pct"), count(none).alias("n_absent"), pct(got.isNull(), none).alias("silent_pct"),
        )
        out = one if out is None else out.union(one)
    return out


def host_verdict(runs: DataFrame, hosts: list[str], least: float = 0.9, n: int = 3) -> DataFrame:
    """(source, shares, verdict) of image lists (run, source, image_urls): whether on each of the last n runs 90 % of the
    listings show their first image from one of the hosts; fewer runs settle nothing."""
    host = F.try_parse_url(F.get("image_urls", F.lit(0)), F.lit("HOST"))
    per = runs.groupBy("source", "run").agg((F.count(F.when(host.isin(hosts), 1)) / F.count("*")).alias("share"))
    w = W.partitionBy("source").orderBy(F.desc("run"))
    last = per.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    out = last.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "share"))), lambda x: half_up(x.share, 4)).alias("shares"), F.min("share").alias("low"))
    return out.select("source", "shares", F.when(F.size("shares") < n, "open").when(F.col("low") >= least, "syndicated").otherwise("own").alias("verdict"))


def validated(objects: DataFrame, text: str, schema: dict[str, str]) -> DataFrame:
    """Adds `valid`, `problem` and a column for each field of a JSON object in `text`.

    schema: field -> bool, number, str, any or enum:a|b, with ? behind it if it may be null or absent. The first field
    that does not hold is the problem.
    """
    doc = F.try_parse_json(text)
    kind = F.schema_of_variant(doc)
    field = lambda f: F.try_variant_get(doc, f"$.{f}", "variant")
    kind_of = lambda f: F.schema_of_variant(field(f))
    checks, values = [F.when(doc.isNull() | ~F.startswith(kind, F.lit("OBJECT")), "no object")], {}
    for f, spec in schema.items():
        free, rule = spec.endswith("?"), spec.rstrip("?")
        void, absent = F.coalesce(kind_of(f) == "VOID", F.lit(False)), field(f).isNull()
        plain = F.try_variant_get(doc, f"$.{f}", "string")
        number = kind_of(f).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|TINYINT|SMALLINT|INT)")
        right = {"bool": kind_of(f) == "BOOLEAN", "number": number, "str": kind_of(f) == "STRING", "any": F.lit(True)}.get(rule)
        if right is None:
            right = (kind_of(f) == "STRING") & plain.isin(rule[5:].split("|"))
        empty = void | absent
        allowed = empty if free else F.lit(False)
        checks.append(F.when(absent & ~F.lit(free), f"missing field: {f}").when(~(allowed | F.coalesce(right, F.lit(False))), f"field {f}"))
        values[f] = plain
    problem = F.coalesce(*checks)
    ok = problem.isNull()
    return objects.select("*", ok.alias("valid"), problem.alias("problem"), *[F.when(ok, v).alias(k) for k, v in values.items()])


def json_or_null(text: Column, schema: str) -> Column:
    """A JSON text by a schema; null where it is no JSON."""
    return F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), schema)


def compared(ours: DataFrame, theirs: DataFrame, stable: list[str], enriched: list[str]) -> DataFrame:
    """(id, state, diverging, gained, price_move) of a local scan against the server's rows (id, status, price, fields).

    States: both (active there), new (unknown there), reappeared (known, not active), absent (active there, not seen).
    Stable fields diverge where both are known and differ, areas by over half a metre; gained are enriched fields known
    here alone; a price moved where both are known and differ by over one.
    """
    names = list(dict.fromkeys(["price", *stable, *enriched]))
    a = ours.select("id", *names)
    b = theirs.select(F.col("id").alias("t_id"), F.col("status").alias("t_status"), *[F.col(c).alias(f"t_{c}") for c in names])
    rows = a.join(b, F.col("id") == F.col("t_id"), "full_outer")
    active = F.col("t_status") == "active"
    state = F.when(F.col("t_id").isNull(), "new").when(F.col("id").isNull() & active, "absent").when(F.col("id").isNotNull() & active, "both").when(F.col("id").isNotNull(), "reappeared")
    both = state == "both"
    text = lambda c: F.trim(F.col(c).cast("string"))
    other = lambda f: F.abs(F.col(f) - F.col(f"t_{f}")) > 0.5 if f == "area_sqm" else text(f) != text(f"t_{f}")
    blank = lambda c: F.col(c).isNull() | (text(c) == "")
    moved = (F.col("price") != 0) & (F.col("t_price") != 0) & (F.abs(F.col("price") - F.col("t_price")) > 1)
    return rows.where(state.isNotNull()).select(
        F.coalesce("id", "t_id").alias("id"), state.alias("state"),
        F.array_join(F.array_compact(F.array(*[F.when(both & other(f), F.lit(f)) for f in stable])), ",").alias("diverging"),
        F.array_join(F.array_compact(F.array(*[F.when(both & ~blank(f) & blank(f"t_{f}"), F.lit(f)) for f in enriched])), ",").alias("gained"),
        F.when(both & moved, F.when(F.col("price") < F.col("t_price"), "down").otherwise("up")).alias("price_move"),
    )


def geocoded(listings: DataFrame, places: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """Active listings without street or place, filled from one lookup for each building and district; only nulls are
    filled. places: (building, khet, street, lat, lng); located: (lat, lng, district) of those places."""
    from ..functions.text import building_name

    rows = listings.where("status = 'active' and condo_name is not null and (street is null or lat is null)")
    rows = rows.withColumn("building", building_name(F.col("condo_name"))).withColumn("__khet", F.coalesce("khet", F.lit("")))
    found = places.select("building", F.coalesce("khet", F.lit("")).alias("__khet"), F.col("street").alias("n_street"), F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng"))
    out = rows.join(found, ["building", "__khet"])
    if located is not None:
        out = out.join(located.select(F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng"), F.col("district").alias("n_khet")), ["n_lat", "n_lng"], "left")
    else:
        out = out.withColumn("n_khet", F.lit(None).cast("string"))
    bare_place = F.col("lat").isNull() & F.col("n_lat").isNotNull() & F.col("n_lng").isNotNull()
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return out.select(
        "id", F.coalesce(blank("street"), "n_street").alias("street"), F.when(bare_place, F.col("n_lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(bare_place, F.col("n_lng")).otherwise(F.col("lng")).alias("lng"), F.coalesce(blank("khet"), "n_khet").alias("khet"),
    )
