"""One query per operator, over whole tables; results hold plain, comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from webstrata import functions as fn
from webstrata.operators import clicks, dedup, filters, frontier, lookups, scope, snapshots
from webstrata.operators import elements as el
from webstrata.operators.ordered import lay_out, rank_in_group
from webstrata.options import CaptureOptions
from webstrata.plans import tables as t
from webstrata.session import cut_lineage, work_path
from webstrata.sources import calls as call_source
from webstrata.sources import cdx, seeds, sinks, store, warc
from webstrata.streaming.record import read_recorded, record_files, stream_record
from webstrata.streaming.stability import OUTPUT, finish_stable, stream_stable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FORMS = CaptureOptions(submit_forms=True)
AGENT = "webstrata-test/1"
INCLUDE, EXCLUDE = (r"blog\..*", r"m\..*\.com"), (r".*\.net",)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _flat(headers: Column | str) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit("="),
                                                                h["value"])), "|")


def _steps(path: Column | str) -> Column:
    return F.array_join(path, " ")


def _seed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.seed_hosts(t.seeds(spark, sf_dir))


def _page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pages(spark, sf_dir).select("page_id", "url", fn.url_host("url").alias("host"))


# Sources and sinks

@query
def s1_seed_source(spark, sf_dir):
    path = work_path(spark, "seeds")
    t.pages(spark, sf_dir).select("url").write.text(path)
    read = seeds.read_seeds(spark, path)
    refs = seeds.seed_refs(read).select("url", F.size("click_path").alias("clicks"))
    return refs.withColumn("host", fn.url_host("url"))


@query
def s2_call_source(spark, sf_dir):
    calls = call_source.calls_from_pages(t.pages(spark, sf_dir))
    return calls.select("call_id", "method", "uri", "status", F.md5("resp_body").alias("body_md5"))


def _archive(spark, sf_dir) -> str:
    path = work_path(spark, "warc")
    warc.write_warc(t.calls(spark, sf_dir), path)
    return path


@query
def s3_warc_source(spark, sf_dir):
    records = warc.read_warc(spark, _archive(spark, sf_dir))
    return records.where(F.col("warc_type").isin("request", "response")).select(
        "warc_type", F.col("target_uri").alias("uri"), F.unix_millis("date").alias("date_ms"),
        "http_method", "http_status", F.md5("payload").alias("payload_md5"))


@query
def s4_warc_sink(spark, sf_dir):
    pairs = lookups.pair_records(warc.read_warc(spark, _archive(spark, sf_dir)))
    return pairs.select(
        F.unix_millis("ts").alias("ts_ms"), "method", "uri", "status",
        _flat("req_headers").alias("req_headers"), F.md5("req_body").alias("req_md5"),
        _flat("resp_headers").alias("resp_headers"), F.md5("resp_body").alias("resp_md5"))


@query
def s3_warc_compressed(spark, sf_dir):
    """Shards of gzip members, indexed and read in ranges: the same records as plain ones."""
    path = work_path(spark, "warc")
    warc.write_warc(t.calls(spark, sf_dir), path, compress=True)
    index = cdx.cdx_index(warc.read_warc(spark, path, payload=False))
    records = warc.read_warc(spark, path, cdx=index, split_bytes=4096)
    return records.where(F.col("warc_type").isin("request", "response")).select(
        "warc_type", F.col("target_uri").alias("uri"), F.unix_millis("date").alias("date_ms"),
        "http_method", "http_status", F.md5("payload").alias("payload_md5"))


@query
def s4_warc_commits(spark, sf_dir):
    """All calls published by commits in two jobs, over an older archive and an older try of a job."""
    path, calls = work_path(spark, "warc"), t.calls(spark, sf_dir)
    good = F.col("status") == 200
    warc.write_warc(calls, path, commits=True)
    warc.write_warc(calls.where(good), path, mode="overwrite", commits=True)
    warc.write_warc(calls, path, job="rest")
    warc.write_warc(calls.where(~good), path, job="rest", compress=True)
    return warc.read_exchanges(spark, path).select(
        F.unix_millis("ts").alias("ts_ms"), "method", "uri", "status",
        _flat("req_headers").alias("req_headers"), F.md5("req_body").alias("req_md5"),
        _flat("resp_headers").alias("resp_headers"), F.md5("resp_body").alias("resp_md5"))


@query
def s5_cdx_index(spark, sf_dir):
    """The index as read back; its places are those where a plain read finds the records."""
    archive, path = _archive(spark, sf_dir), work_path(spark, "cdx")
    records = warc.read_warc(spark, archive, payload=False)
    cdx.write_cdx(cdx.cdx_index(records), path)
    there = records.select("filename", "offset", F.col("length").alias("there"),
                           F.col("target_uri").alias("uri"))
    listed = cdx.read_cdx(spark, path).join(there, ["filename", "offset"], "left")
    return listed.select(
        "urlkey", "ts", "url", "mime", "status", "redirect", "meta", "digest",
        (F.col("offset") > 0).alias("has_offset"),
        F.coalesce((F.col("length") == F.col("there")) & (F.col("url") == F.col("uri")),
                   F.lit(False)).alias("in_place"))


@query
def s5_cdx_range_read(spark, sf_dir):
    """Reads shards in ranges found through the index: the same records as a plain read."""
    path = _archive(spark, sf_dir)
    index = cdx.cdx_index(warc.read_warc(spark, path, payload=False))
    records = warc.read_warc(spark, path, cdx=index, split_bytes=4096)
    return records.where(F.col("warc_type") == "response").select(
        F.col("target_uri").alias("uri"), F.col("http_status").alias("status"),
        F.md5("payload").alias("payload_md5"))


@query
def s6_call_log(spark, sf_dir):
    return call_source.call_log(filters.recordable(t.calls(spark, sf_dir)))


def _call_files(spark, sf_dir) -> DataFrame:
    path = work_path(spark, "calls")
    t.calls(spark, sf_dir).write.parquet(path)
    return call_source.read_calls(spark, path)


@query
def s7_response_store(spark, sf_dir):
    path = work_path(spark, "store")
    store.save_responses(_call_files(spark, sf_dir), path)
    return store.read_responses(spark, path).select(
        "request_key", "call_id", "status", F.md5("resp_body").alias("body_md5"))


@query
def s8_response_json(spark, sf_dir):
    stored = dedup.dedup_calls(t.calls(spark, sf_dir))
    lines = store.responses_to_json(stored)
    back = store.responses_from_json(lines).select(
        "request_key", "status", _flat("resp_headers").alias("headers"),
        F.md5("resp_body").alias("body_md5"))
    text = lines.select("request_key",
                        F.get_json_object("json", "$.contentBytes").alias("content"))
    return back.join(text, "request_key")


@query
def s9_clear_on_init(spark, sf_dir):
    """Appending keeps what is stored; clearing first leaves only the second save."""
    calls = t.calls(spark, sf_dir)
    gets, posts = calls.where(F.col("method") == "GET"), calls.where(F.col("method") == "POST")
    outcomes = []
    for name, clear in (("kept", False), ("cleared", True)):
        path = work_path(spark, "store")
        store.save_responses(gets, path)
        store.save_responses(posts, path, clear=clear)
        outcomes.append(store.read_responses(spark, path).select(
            F.lit(name).alias("outcome"), "request_key", "call_id"))
    return outcomes[0].union(outcomes[1])


@query
def s10_sink_plugins(spark, sf_dir):
    """Sinks chosen by name and by class path; the archive sink also builds its index."""
    root = work_path(spark, "sinks")
    opts = CaptureOptions(store_path=f"{root}/store", warc_path=f"{root}/warc",
                          cdx_path=f"{root}/cdx")
    sinks.record(filters.recordable(t.calls(spark, sf_dir)), opts, "store",
                 "webstrata.sources.sinks:WarcSink")
    stored = store.read_responses(spark, opts.store_path).select(
        F.lit("store").alias("sink"), F.col("status").cast("string").alias("status"))
    indexed = cdx.read_cdx(spark, opts.cdx_path).select(F.lit("archive").alias("sink"), "status")
    return stored.union(indexed).groupBy("sink", "status").agg(F.count("*").alias("calls"))


# Projections

@query
def p1_canonical_url(spark, sf_dir):
    return t.pages(spark, sf_dir).select("page_id", fn.canonical_url("url").alias("canonical"))


@query
def p1_canonical_escaped(spark, sf_dir):
    """Escapes, decoded and quoted again; one URL form per part."""
    page = t.pages(spark, sf_dir).select("page_id", F.split_part("url", F.lit("?"), F.lit(1))
                                         .alias("u"))
    bare = F.split_part("u", F.lit("#"), F.lit(1))
    forms = F.array(
        F.concat(bare, F.lit("/%41%7E%2Fb%20c?x=%26y+%2B#f")), F.concat(bare, F.lit("/%C3%A9%25")),
        F.concat(bare, F.lit("/%zz")), F.concat(bare, F.lit("/a b")),
        F.concat(F.lit("mailto:"), bare), F.replace(bare, F.lit("://"), F.lit(":///")))
    exploded = page.select("page_id", F.posexplode(forms).alias("form", "form_url"))
    return exploded.select("page_id", "form", fn.canonical_url("form_url").alias("canonical"))


@query
def p1_sql_functions(spark, sf_dir):
    """The URL and key functions called from SQL text."""
    fn.register_functions(spark)
    t.calls(spark, sf_dir).createOrReplaceTempView("_calls")
    return spark.sql("""
        SELECT call_id, canonical_url(uri) AS canonical, url_host(uri) AS host,
               url_scheme(uri) AS scheme, page_key(method, uri) AS page_key,
               request_key(method, uri, req_body) AS request_key FROM _calls""")


@query
def p2_page_key(spark, sf_dir):
    return t.calls(spark, sf_dir).select("call_id", fn.page_key("method", "uri").alias("page_key"))


@query
def p3_request_key(spark, sf_dir):
    return t.calls(spark, sf_dir).select(
        "call_id", fn.request_key("method", "uri", "req_body").alias("request_key"))


@query
def p4_host_scheme(spark, sf_dir):
    return t.calls(spark, sf_dir).select("call_id", fn.url_host("uri").alias("host"),
                                         fn.url_scheme("uri").alias("scheme"))


@query
def p5_header_override(spark, sf_dir):
    return t.calls(spark, sf_dir).select(
        "call_id", _flat(fn.override_headers("req_headers")).alias("plain"),
        _flat(fn.override_headers("req_headers", AGENT)).alias("with_agent"))


@query
def p6_headers_table(spark, sf_dir):
    return fn.headers_table(t.calls(spark, sf_dir))


@query
def p6_flatten_headers(spark, sf_dir):
    """Multimaps rebuilt from the recorded headers, every value listed twice."""
    multimap = F.transform("resp_headers", lambda h: F.struct(
        h["name"].alias("name"), F.array(h["value"], h["value"]).alias("values")))
    return t.calls(spark, sf_dir).select(
        "call_id", _flat(fn.flatten_headers(multimap)).alias("headers"))


@query
def p7_content_type(spark, sf_dir):
    return t.calls(spark, sf_dir).select(
        "call_id", fn.content_type("resp_headers").alias("content_type"),
        fn.content_type("req_headers").alias("sent_type"))


@query
def p8_recorded_body(spark, sf_dir):
    return t.calls(spark, sf_dir).select(
        "call_id", F.md5(fn.recorded_body("method", "req_body")).alias("req_md5"),
        F.md5("resp_body").alias("resp_md5"))


@query
def p9_ref_label(spark, sf_dir):
    refs = clicks.expand_clicks(t.dom_observations(spark, sf_dir))
    return refs.select(fn.ref_label("url", "click_path").alias("label"))


@query
def p10_resolve_href(spark, sf_dir):
    """Links of the pages and, made from the same texts, links of every other form."""
    found = el.clickable_elements(t.pages(spark, sf_dir)).select("page_id", "url", "pos", "href")
    word = F.substr("href", F.lit(2))
    forms = F.array(
        F.col("href"), word, F.concat(F.lit("../"), word), F.concat(F.lit("?q="), word),
        F.concat(F.lit("#"), word), F.concat(F.lit("//other.example.org"), F.col("href")),
        F.concat(F.lit("HTTP://Other.Example.org:80/a/./b/.."), F.col("href")))
    exploded = found.select("page_id", "url", "pos", F.posexplode(forms).alias("form", "ref"))
    return exploded.select("page_id", "pos", "form",
                           fn.resolve_href("url", None, "ref").alias("link"))


# Elements

@query
def x1_clickable_elements(spark, sf_dir):
    return el.clickable_elements(t.pages(spark, sf_dir)).select(
        "page_id", "url", "pos", "tag", "href", "href_abs", "source")


@query
def x2_submit_elements(spark, sf_dir):
    """No given page has a form: each gets one around its first heading."""
    form = ("<form><input type=submit name=a><button type=\"submit\">b</button>"
            "<button type=\"Submit\">c</button></form>")
    with_form = t.pages(spark, sf_dir).select("page_id", "url", F.regexp_replace(
        "html", "<h1>", f"{form}<h1>").alias("html"))
    return el.submit_elements(with_form, FORMS).select("page_id", "pos", "tag", "source")


@query
def x3_listener_elements(spark, sf_dir):
    observed = t.dom_observations(spark, sf_dir).withColumnRenamed("candidates", "listeners")
    return el.listener_elements(observed).select("url", "pos", "path", "href", "source")


@query
def x4_ancestor_path(spark, sf_dir):
    return t.elements(spark, sf_dir).select("page_id", "path", "tag", "href")


@query
def x5_path_lookup(spark, sf_dir):
    """Looks up every link's address, one beyond it, and its parent's."""
    found = t.links(spark, sf_dir)
    wanted = found.select("page_id", F.explode(F.array(
        F.col("path"), F.concat("path", F.lit("7>")),
        F.regexp_replace("path", r"\d+>$", ""))).alias("path"))
    everything = el.dom_elements(t.pages(spark, sf_dir))
    return el.lookup_path(everything, wanted).select("page_id", "path", "found_tag",
                                                     "found_path")


# Filters

@query
def f1_unwanted_protocols(spark, sf_dir):
    """Links of the pages behind each dropped protocol, and behind two kept ones."""
    found = el.clickable_elements(t.pages(spark, sf_dir))
    protocols = [*filters.UNWANTED_PROTOCOLS, "MAILTO", "javascript"]
    shown = [F.col("href"), *[F.concat(F.lit(f"{p}:"), F.col("href")) for p in protocols],
             F.lit("mailto:"), F.lit(None).cast("string")]
    spread = found.select("page_id", "pos", "url", "href_abs",
                          F.explode(F.array(*shown)).alias("href"))
    return filters.drop_unwanted_href(spread).select("page_id", "pos", "href")


@query
def f2_external_scope(spark, sf_dir):
    hosts = _page_hosts(spark, sf_dir)
    return hosts.where(filters.external_scope("host", INCLUDE, EXCLUDE)).select("page_id", "host")


@query
def f3_in_scope(spark, sf_dir):
    opts = CaptureOptions(include_hosts=INCLUDE, exclude_hosts=EXCLUDE,
                          include_local_files=True)
    page = t.pages(spark, sf_dir).select("page_id", "url")
    local = page.select("page_id", F.regexp_replace("url", "^https?://", "file:///").alias("url"))
    return scope.in_scope(page.union(local), _seed_hosts(spark, sf_dir), opts)


@query
def f4_omissions(spark, sf_dir):
    return filters.omissions(t.calls(spark, sf_dir))


@query
def f5_click_depth(spark, sf_dir):
    """Paths of zero to three clicks, with a limit of one and with none."""
    found = t.links(spark, sf_dir)
    deeper = found.select("url", F.explode(F.array(
        *[F.array_repeat("path", n) for n in range(4)])).alias("click_path"))
    limited = filters.within_click_depth(deeper, 1).withColumn("depth_limit", F.lit(1))
    free = filters.within_click_depth(deeper, 0).withColumn("depth_limit", F.lit(0))
    return limited.union(free).select("url", "depth_limit", _steps("click_path").alias("steps"))


@query
def f6_navigated(spark, sf_dir):
    """Navigations to links and, not counted, to fragments of the same page."""
    moves = t.navigations(spark, sf_dir)
    same = moves.withColumn("current_url", F.concat(
        F.split_part("url", F.lit("#"), F.lit(1)), F.lit("#moved")))
    return filters.navigated(moves.union(same)).select("visit_id", "click_no", "current_url")


@query
def f7_recordable(spark, sf_dir):
    return filters.recordable(t.calls(spark, sf_dir)).select("call_id", "status")


# Joins

@query
def j1_seed_scope(spark, sf_dir):
    hosts = _page_hosts(spark, sf_dir)
    return scope.seed_scope(hosts, _seed_hosts(spark, sf_dir), True).select("page_id", "host")


def _subdomains(spark, sf_dir) -> DataFrame:
    """Page hosts below themselves, beside themselves, and as they are."""
    return _page_hosts(spark, sf_dir).select("page_id", F.explode(F.array(
        F.col("host"), F.concat(F.lit("a.b."), "host"), F.concat(F.lit("evil"), "host"),
        F.upper("host"))).alias("host"))


@query
def j1_seed_scope_subdomains(spark, sf_dir):
    return scope.seed_scope(_subdomains(spark, sf_dir), _seed_hosts(spark, sf_dir), True)


@query
def j1_seed_scope_exact(spark, sf_dir):
    return scope.seed_scope(_subdomains(spark, sf_dir), _seed_hosts(spark, sf_dir), False)


@query
def j1_seed_scope_long_list(spark, sf_dir):
    """Seeds among very many hosts, one per order, that no page has."""
    others = t.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("shop."), F.col("o_orderkey"), F.lit(".invalid")).alias("host"))
    seed_hosts = _seed_hosts(spark, sf_dir).select("host").union(others)
    return scope.seed_scope(_subdomains(spark, sf_dir), seed_hosts, True)


def _stored(spark, sf_dir) -> tuple[DataFrame, int | None]:
    """Successful page fetches of a store, and its buckets: chat turns and errors are misses."""
    path = work_path(spark, "store")
    store.save_responses(t.calls(spark, sf_dir).where(F.col("method") == "GET"), path)
    rows = store.read_responses(spark, path).where(F.col("status") == 200)
    return rows, store.store_buckets(spark, path)


@query
def j2_response_lookup(spark, sf_dir):
    requests = dedup.with_request_key(t.calls(spark, sf_dir)).select(
        "call_id", "method", "request_key")
    found = lookups.lookup_stored(requests, *_stored(spark, sf_dir))
    return found.select("call_id", "request_key", "is_hit", "stored_status",
                        F.md5("stored_body").alias("stored_md5"))


@query
def j2_uncached(spark, sf_dir):
    requests = dedup.with_request_key(t.calls(spark, sf_dir)).select("call_id", "request_key")
    return lookups.uncached_stored(requests, *_stored(spark, sf_dir)).select("call_id")


@query
def j2_plain_lookup(spark, sf_dir):
    """Responses that lie in no buckets: a salted join."""
    requests = dedup.with_request_key(t.calls(spark, sf_dir)).select(
        "call_id", "method", "request_key")
    found = lookups.lookup_responses(requests, t.responses(spark, sf_dir))
    return found.select("call_id", "request_key", "is_hit", "stored_status",
                        F.md5("stored_body").alias("stored_md5"))


@query
def j3_drop_omitted(spark, sf_dir):
    calls = t.calls(spark, sf_dir)
    refs = calls.select(F.col("call_id").alias("visit_id"), F.col("uri").alias("url"))
    return lookups.drop_omitted(refs, filters.omissions(calls)).select("visit_id", "url")


@query
def j4_fresh_navigations(spark, sf_dir):
    moves = lookups.fresh_navigations(t.navigations(spark, sf_dir), t.fetched(spark, sf_dir))
    return moves.select("visit_id", "click_no", "current_url")


@query
def j5_mutation_match(spark, sf_dir):
    seen = t.dom_observations(spark, sf_dir).select("url", F.explode(clicks.mutation_match(
        F.col("candidates"), "mutated_paths")).alias("one"))
    return seen.select("url", F.col("one.path").alias("path"))


@query
def j6_pair_records(spark, sf_dir):
    pairs = lookups.pair_records(warc.read_warc(spark, _archive(spark, sf_dir)))
    return pairs.groupBy("method", "status").agg(
        F.count("*").alias("pairs"), F.sum(F.octet_length("resp_body")).alias("bytes"))


@query
def j6_exchanges(spark, sf_dir):
    """Exchanges paired where they lie, in small ranges, whose borders part many of them."""
    path, index = _archive(spark, sf_dir), work_path(spark, "offsets")
    warc.write_offsets(warc.read_warc(spark, path, payload=False), index, 4096)
    return warc.read_exchanges(spark, path, index, split_bytes=16384).select(
        F.unix_millis("ts").alias("ts_ms"), "method", "uri", "status",
        _flat("req_headers").alias("req_headers"), F.md5("req_body").alias("req_md5"),
        _flat("resp_headers").alias("resp_headers"), F.md5("resp_body").alias("resp_md5"))


# Deduplication, rounds, stability

@query
def d1_dedup_calls(spark, sf_dir):
    return dedup.dedup_call_files(_call_files(spark, sf_dir)).select(
        "call_id", "request_key", "status", F.md5("resp_body").alias("body_md5"))


@query
def d1_dedup_derived(spark, sf_dir):
    """Calls that come from no files: bodies join by the unique call_id."""
    return dedup.dedup_calls(t.calls(spark, sf_dir)).select(
        "call_id", "request_key", "status", F.md5("resp_body").alias("body_md5"))


@query
def d2_unvisited(spark, sf_dir):
    """Pages as candidates; those fetched successfully at first are visited."""
    calls = t.calls(spark, sf_dir)
    candidates = calls.select(fn.canonical_url("uri").alias("url"))
    visited = filters.recordable(calls).where(F.col("status") != 200).select(
        fn.canonical_url("uri").alias("url"))
    return dedup.unvisited(candidates, visited)


@query
def d3_politeness_rounds(spark, sf_dir):
    return dedup.politeness_rounds(t.calls(spark, sf_dir))


@query
def d4_first_stable(spark, sf_dir):
    return snapshots.first_stable(t.snapshots(spark, sf_dir), timeout_ms=None)


@query
def d4_first_stable_timeout(spark, sf_dir):
    return snapshots.first_stable(t.snapshots(spark, sf_dir), timeout_ms=2 * t.DAY)


# Click sequences and frontier

@query
def u1_candidates(spark, sf_dir):
    observed = t.dom_observations(spark, sf_dir).withColumnRenamed("candidates", "listeners")
    attribute = t.elements(spark, sf_dir)
    both = el.candidates(el.listener_elements(observed), attribute, None, CaptureOptions())
    return both.select("url", "path", "href_abs", "source")


@query
def i1_expand_clicks(spark, sf_dir):
    return clicks.expand_clicks(t.dom_observations(spark, sf_dir)).select(
        "url", _steps("click_path").alias("steps"))


@query
def i2_reclick(spark, sf_dir):
    return clicks.reclick(t.dom_observations(spark, sf_dir)).select(
        "url", _steps("click_path").alias("steps"))


@query
def i3_next_frontier(spark, sf_dir):
    page = t.pages(spark, sf_dir)
    visited = page.select(fn.canonical_url("url").alias("url"))
    wave = frontier.next_frontier(page, _seed_hosts(spark, sf_dir), visited)
    return wave.select("url", "host", F.size("click_path").alias("clicks"))


@query
def i3_navigation_refs(spark, sf_dir):
    """Clicks to a fragment of each link; every fifth page's links were visited before."""
    moves = t.navigations(spark, sf_dir)
    visited = moves.where(F.col("visit_id") % 5 == 0).select(
        fn.canonical_url("current_url").alias("url"))
    shown = moves.withColumn("current_url", F.concat("current_url", F.lit("#at")))
    refs = frontier.navigation_refs(shown, t.fetched(spark, sf_dir), _seed_hosts(spark, sf_dir),
                                    visited)
    return refs.select("url", "host", F.size("click_path").alias("clicks"))


@query
def i4_reachable(spark, sf_dir):
    starts = t.pages(spark, sf_dir).where(F.col("url").rlike("^http://[^/]+/es/")).select(
        F.col("page_id").alias("node"))
    return frontier.reachable(t.edges(spark, sf_dir), starts)


# Streaming

def _arrive(arrivals: list[DataFrame], source: str,
            stream: Callable[[int], DataStreamWriter]) -> None:
    """Rows that arrive as files of a folder, in several tasks; a micro-batch takes each arrival.

    ``stream`` takes the number of an arrival's files, the most of its micro-batch.
    """
    known = 0
    for rows in arrivals:
        rows.write.mode("append").parquet(source)
        files = len(rows.sparkSession.read.schema(rows.schema).parquet(source).inputFiles())
        stream(files - known).trigger(availableNow=True).start().awaitTermination()
        known = files


def _arrivals(spark, sf_dir) -> list[DataFrame]:
    """The calls in four arrivals, in the order of their time."""
    calls, hours = t.calls(spark, sf_dir), (0, 1, 5, 24, 1 << 20)
    hour = F.floor((F.unix_millis("ts") - t.START_MS) / 3_600_000)
    return [calls.where((hour >= low) & (hour < high)) for low, high in zip(hours, hours[1:])]


def _recorded(spark, root) -> DataFrame:
    return read_recorded(spark, f"{root}/out").select(
        "request_key", "call_id", "status", F.md5("resp_body").alias("body_md5"))


@query
def t1_stream_record(spark, sf_dir):
    """The calls as a stream of files, an arrival to a micro-batch, recorded once each from keyed state."""
    root = work_path(spark, "stream")
    _arrive(_arrivals(spark, sf_dir), f"{root}/in", lambda files: record_files(
        spark, f"{root}/in", f"{root}/out", max_files=files).option(
        "checkpointLocation", f"{root}/state"))
    return _recorded(spark, root)


@query
def t1_stream_record_any_source(spark, sf_dir):
    """The same by the form for streams of any source, against the recorded keys."""
    root, calls = work_path(spark, "stream"), _arrivals(spark, sf_dir)

    def stream(files: int) -> DataStreamWriter:
        arrived = spark.readStream.schema(calls[0].schema).option(
            "maxFilesPerTrigger", files).parquet(f"{root}/in")
        return stream_record(arrived, f"{root}/out").option("checkpointLocation", f"{root}/state")

    _arrive(calls, f"{root}/in", stream)
    return _recorded(spark, root)


@query
def t2_stream_stable(spark, sf_dir):
    """The snapshots as a stream; equals the batch form."""
    root = work_path(spark, "stream")
    shots = t.snapshots(spark, sf_dir)
    shots.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(shots.schema).parquet(f"{root}/in")
    stream_stable(stream, timeout_ms=36_500 * t.DAY).writeStream.format("parquet").option(
        "path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(
        availableNow=True).start().awaitTermination()
    emitted = spark.read.schema(OUTPUT).parquet(f"{root}/out")
    return emitted.unionByName(finish_stable(spark, f"{root}/state", 36_500 * t.DAY))


@query
def t2_stream_shuffled(spark, sf_dir):
    """Snapshots numbered per key that arrive in any order, over four micro-batches."""
    root = work_path(spark, "stream")
    laid = lay_out(t.snapshots(spark, sf_dir), ["key"], ["seq"])
    shots = rank_in_group(laid, ["key"], ["seq"], "number").select(
        "key", F.col("number").alias("seq"), "ts", "html")
    part = F.pmod(F.xxhash64("key", "seq"), F.lit(4))
    numbered = cut_lineage(shots)

    def stream(files: int) -> DataStreamWriter:
        arrived = spark.readStream.schema(shots.schema).option(
            "maxFilesPerTrigger", files).parquet(f"{root}/in")
        return stream_stable(arrived, 2 * t.DAY, first_seq=1).writeStream.format("parquet").option(
            "path", f"{root}/out").option("checkpointLocation", f"{root}/state")

    _arrive([numbered.where(part == number) for number in range(4)], f"{root}/in", stream)
    emitted = spark.read.schema(OUTPUT).parquet(f"{root}/out")
    return emitted.unionByName(finish_stable(spark, f"{root}/state", 2 * t.DAY))
