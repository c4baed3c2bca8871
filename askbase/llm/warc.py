"""Not-modified revisits resolved to the response they stand for.

A crawler stores a 304 answer without a body. It stands for the latest earlier
full response of the same canonical URL, if their validators agree. Records are
put in order of (canonical URL, time, record id) by range partitioning, which
cuts through a URL with very many captures like through any other rows; each
task carries the last full response along. What a partition leaves to the next
ones is one row (its last URL and response), and revisits that find no response
in their own partition take the nearest of those. Bodies do not travel: a
response is carried as its id, digest, length and headers.

Validators: entity tags decide where both sides have one (compared weakly: the
mark W/ does not count), else the times of last modification. ``status``:
``resolved`` (they agree), ``unchecked`` (no validator in common), ``mismatch``,
``orphan`` (no earlier response, or no URL). The merged headers of the first two
are the response's, updated by the revisit's except for those that describe a
body or a connection.

Defined cases: "earlier" is by time and, at the same time, by record id; null
times come before all others, null ids before other ids. A full response has
status 200 and a body (an empty body counts). Repeated records each get their
row. Header names are compared in lower case; null maps are empty.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import stored, table

#: Headers that a 304 answer may not change.
FORBIDDEN = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
             "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
             "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that only track where a visitor came from.
TRACKING = r"(utm_[^=&]*|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment, tracking, or closing slash."""
    plain = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(
        F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"),
        lambda x: (x != "") & ~F.regexp_like(x, F.lit(f"^{TRACKING}(=|$)")))), "&")
    return F.concat(head, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def lower_names(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only the first one's value stays."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.coalesce(F.map_from_entries(F.transform(names, lambda n: F.struct(
        n.alias("key"), F.filter(entries, lambda e: F.lower(e["key"]) == n)[0]["value"].alias("value")))),
        F.create_map().cast("map<string,string>"))


_FULL = "struct<response_id:bigint,digest:string,length:bigint,headers:map<string,string>>"


def _carry(batches):
    """Revisit rows with the last response before them in this partition, then one row to carry on."""
    from pyspark import TaskContext
    part, url, full, first, any_row = TaskContext.get().partitionId(), None, None, None, False
    schema = pa.schema([
        ("part", pa.int32()), ("canonical", pa.string()), ("record_id", pa.int64()), ("time", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())), ("open", pa.bool_()), ("carry", pa.bool_()),
        ("full", pa.struct([("response_id", pa.int64()), ("digest", pa.string()), ("length", pa.int64()),
                            ("headers", pa.map_(pa.string(), pa.string()))]))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not any_row:
                any_row, first, url = True, r["canonical"], r["canonical"]
            if r["canonical"] != url:
                url, full = r["canonical"], None
            if r["revisit"]:
                out.append({"part": part, "canonical": url, "record_id": r["record_id"], "time": r["time"],
                            "headers": r["headers"], "open": full is None and url == first and url is not None,
                            "carry": False, "full": full if url is not None else None})
            else:
                full = {"response_id": r["record_id"], "digest": r["digest"], "length": r["length"],
                        "headers": r["headers"]}
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if full is not None and url is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "canonical": url, "open": False, "carry": True,
                                           "full": full}], schema=schema)


def _agree(mine: Column, theirs: Column) -> Column:
    def tag(h):
        return F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")

    def modified(h):
        return F.try_element_at(h, F.lit("last-modified"))

    return F.coalesce(tag(mine) == tag(theirs), modified(mine) == modified(theirs))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records``.

    Needs record_id, time (bigint), url, status, headers (map), body (string or
    null); further columns are ignored. Gives record_id, time, canonical,
    status, response_id, digest, length and the merged headers.
    """
    rows = records.where("status = 304 OR status = 200 AND body IS NOT NULL").select(
        F.nullif(canonical_url(F.col("url")), F.lit("")).alias("canonical"), F.col("time").cast("bigint").alias("time"),
        F.col("record_id").cast("bigint").alias("record_id"), (F.col("status") == 304).alias("revisit"),
        F.sha2(F.col("body").cast("binary"), 256).alias("digest"),
        F.octet_length("body").cast("bigint").alias("length"), lower_names(F.col("headers")).alias("headers"))
    order = ["canonical", "time", "record_id", "revisit"]
    carried = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _carry, f"part int, canonical string, record_id bigint, time bigint, headers map<string,string>, "
                f"open boolean, carry boolean, full {_FULL}"), "warc-carried")
    # at most one row for each partition: the response it hands on
    handed = (carried.where("carry").groupBy(F.col("canonical").alias("url"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("p"), F.struct(
                  "full.response_id", "full.digest", "full.length",
                  F.map_entries("full.headers").alias("headers")).alias("full")))).alias("parts")))
    joined = carried.where("NOT carry").join(F.broadcast(handed), F.col("open") & (F.col("canonical") == F.col("url")),
                                             "left")
    late = F.element_at(F.filter("parts", lambda x: x["p"] < F.col("part")), -1)["full"]
    late = F.when(late.isNotNull(), F.struct(late["response_id"].alias("response_id"), late["digest"].alias("digest"),
                                             late["length"].alias("length"),
                                             F.map_from_entries(late["headers"]).alias("headers")))
    found = joined.select("record_id", "time", "canonical", "headers",
                          F.when(F.col("full").isNotNull(), F.col("full"))
                          .when(F.size(F.filter("parts", lambda x: x["p"] < F.col("part"))) > 0, late).alias("full"))
    agree = _agree(F.col("headers"), F.col("full.headers"))
    status = F.when(F.col("full").isNull(), "orphan").when(agree.isNull(), "unchecked").when(
        agree, "resolved").otherwise("mismatch")
    told = found.withColumn("status", status)
    change = F.map_filter("headers", lambda k, v: ~k.isin(FORBIDDEN))
    kept = F.map_filter("full.headers", lambda k, v: ~F.array_contains(F.map_keys(change), k))
    good = F.col("status").isin("resolved", "unchecked")
    return told.select(
        "record_id", "time", "canonical", "status",
        *[F.when(good, F.col(f"full.{c}")).alias(c) for c in ("response_id", "digest", "length")],
        F.when(good, F.map_concat(kept, change)).alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl derived from pages: a response for each, and a later visit that found it not modified."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.col("page_id") % 28)
    responses = pages.select(
        (2 * F.col("page_id")).alias("record_id"), (10 * F.col("page_id")).alias("time"), "url",
        F.lit(200).alias("status"), F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/html"),
            F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"),
            F.lit("max-age=60")).alias("headers"), F.col("html").alias("body"))
    seen = F.when(F.col("page_id") % 5 == 0, F.lit(None)).when(F.col("page_id") % 7 == 0, F.lit('"other"')).when(
        F.col("page_id") % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    given = F.create_map(F.lit("etag"), seen, F.lit("last-modified"),
                         F.when(F.col("page_id") % 11 != 0, day), F.lit("cache-control"), F.lit("max-age=600"),
                         F.lit("content-length"), F.lit("0"))
    revisits = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"),
        (10 * F.col("page_id") + 5 + 1000 * (F.col("page_id") % 40)).alias("time"),
        F.concat("url", F.lit("#again")).alias("url"), F.lit(304).alias("status"),
        F.map_filter(given, lambda k, v: v.isNotNull()).alias("headers"), F.lit(None).cast("string").alias("body"))
    return responses.unionByName(revisits)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve_revisits(records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    merged = F.array_join(F.array_sort(F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return done.select("record_id", "time", "canonical", "status", "response_id", "digest", "length",
                       merged.alias("merged_headers"))


SQL = r"""
WITH page AS (
    SELECT page_id, url, html, regexp_replace(url, '#.*$', '') AS plain,
           chr(34) || substr(md5(html), 1, 16) || chr(34) AS tag, 'day ' || (page_id % 28) AS day FROM pages),
split AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)),
                  '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') AS head,
           regexp_replace(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM page),
parts AS (
    SELECT *, regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', '') AS path,
           array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|ref|fbclid|gclid|sessionid)(=|$)'))),
               '&') AS query FROM split),
named AS (SELECT *, head || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM parts),
full_ AS (
    SELECT 2 * page_id AS record_id, 10 * page_id AS time, canonical, tag AS f_tag, day AS f_day,
           sha256(html) AS digest, octet_length(encode(html)) AS length FROM named WHERE html IS NOT NULL),
revisit AS (
    SELECT 2 * page_id + 1 AS record_id, 10 * page_id + 5 + 1000 * (page_id % 40) AS time, canonical,
           CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN chr(34) || 'other' || chr(34)
                WHEN page_id % 3 = 0 THEN 'W/' || tag ELSE tag END AS r_tag,
           CASE WHEN page_id % 11 <> 0 THEN day END AS r_day FROM named),
joined AS (
    SELECT r.*, f.record_id AS response_id, f.digest, f.length, f.f_tag, f.f_day,
           coalesce(regexp_replace(r.r_tag, '^W/', '') = f.f_tag, r.r_day = f.f_day) AS agree
    FROM revisit r ASOF LEFT JOIN full_ f ON r.canonical = f.canonical AND r.time >= f.time),
told AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN agree IS NULL THEN 'unchecked'
                        WHEN agree THEN 'resolved' ELSE 'mismatch' END AS status FROM joined)
SELECT record_id, time, canonical, status,
       CASE WHEN status IN ('resolved', 'unchecked') THEN response_id END AS response_id,
       CASE WHEN status IN ('resolved', 'unchecked') THEN digest END AS digest,
       CASE WHEN status IN ('resolved', 'unchecked') THEN CAST(length AS BIGINT) END AS length,
       CASE WHEN status IN ('resolved', 'unchecked') THEN
           'cache-control=max-age=600|content-length=' || length || '|content-type=text/html|etag='
           || coalesce(r_tag, f_tag) || '|last-modified=' || coalesce(r_day, f_day) END AS merged_headers
FROM told
"""
