"""Rounds of a run against a queue that visits one target at a time."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions.urls import normalize_detail_url, source_url_key
from sheaf.jobs.crawl import DETAILS, crawl_job
from sheaf.operators import frontier, pages
from sheaf.operators.frontier import Budgets

HOME = "https://p.example.org"


def site(rng, n):
    """Page rows (page_id, url, html, records, empty) of a random site with lists, details, notes, routes not recognised, and links that lead nowhere."""
    urls = [f"{HOME}/app/test-results", f"{HOME}/app/visits", f"{HOME}/clinical/testresults"]
    forms = ["/app/test-results/details?eorderid={}", "/app/visits/note?noteid=1&csn={}", "/clinical/result/more?orderid={}", "/clinical/visit/more?lrpid={}"]
    urls += [HOME + rng.choice(forms).format(i) for i in range(n)]
    gone = [HOME + f.format(900 + i) for i, f in enumerate(forms)] + [f"{HOME}/login", "https://other.example.org/app/visits/note?noteid=2&csn=1", f"{HOME}/app/visits/note?csn=5&mode=proxyswitch&action=switchcontext"]
    rows = []
    for i, url in enumerate(urls):
        some = [] if i == 0 and rng.random() < 0.5 else rng.choices(urls[3:], k=rng.randrange(6)) + rng.sample(gone, rng.randrange(3))
        rng.shuffle(some)
        html = "".join('<p><a href="{}">Result details</a></p>'.format(u.replace("&", "&amp;")) for u in some)
        rows.append((i, url, f"<main>{html}</main>", rng.randrange(3) if i > 2 else 0, False))
    return rows


def queued(spark, rows, seeds, covered, seen_before, budgets, context, exhaustive, force):
    """The visits of a queue, one target at a time."""
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, records long, empty boolean")
    raw = pages.extract_links(frame).crossJoin(spark.createDataFrame([("test-results",), ("visits",)], "category string"))
    raw = raw.withColumn("url", normalize_detail_url(F.col("href"), F.col("category")))
    links = {}
    for r in frontier.classified(raw, context, HOME).orderBy("pos").collect():
        links.setdefault((r["page_id"], r["category"]), []).append(r)
    by_url = {r[1]: r for r in rows}
    start = frontier.classified(seeds.withColumn("text", F.lit("")).drop("identity_hash"), context, HOME).collect()
    queue = [{**s.asDict(), "strict": s["route"]["route_class"] in DETAILS and not s["refresh"], "broad": False} for s in sorted(start, key=lambda s: (s["priority"], s["refresh"], s["url"]))]
    seen = {q["identity_hash"] for q in queue}
    waiting, out, spent = [], [], [0, 0, 0]
    while queue or waiting:
        if not queue:
            exhaustive, queue, waiting = True, waiting, []
        t = queue.pop(0)
        stop = "max_pages" if spent[0] >= budgets.pages else "max_records" if spent[2] >= budgets.records else "max_broad" if t["broad"] and spent[1] >= budgets.broad else ""
        if stop:
            out.append((t["url"], stop))
            return out, stop
        detail = t["strict"] or t["broad"]
        if not force and ((detail and t["identity_hash"] in covered) or (t["url"] in seen_before and not detail and not t["refresh"])):
            out.append((t["url"], "skipped"))
            continue
        spent[1] += t["broad"]
        page = by_url.get(t["url"])
        out.append((t["url"], "visited" if page else "failed"))
        if not page:
            continue
        spent[0] += 1
        spent[2] += page[3]
        fit = [x for x in links.get((page[0], t["category"]), []) if x["route"]["admission"] != "rejected" and not (context and x["route"]["route_class"] == "proxy-switch")]
        for x in sorted(fit, key=lambda x: x["route"]["route_class"] not in DETAILS):
            if x["identity_hash"] not in seen:
                seen.add(x["identity_hash"])
                strict = x["route"]["admission"] == "strict"
                own = {**x.asDict(), "strict": strict, "broad": not strict, "refresh": False, "fallback_url": ""}
                (queue if strict or exhaustive else waiting).append(own)
        if t["refresh"] and not fit and not page[3] and not page[4]:
            exhaustive = True
            if t["fallback_url"]:
                other = spark.createDataFrame([(t["fallback_url"], "", t["category"])], "url string, text string, category string")
                h = frontier.classified(other, context, HOME).first()["identity_hash"]
                if h not in seen:
                    seen.add(h)
                    queue.append({**t, "url": t["fallback_url"], "fallback_url": "", "identity_hash": h, "strict": False, "broad": True})
    return out, "queue_exhausted"


@pytest.mark.parametrize("case", range(5))
def test_rounds_are_those_of_a_queue(spark, case):
    rng = random.Random(case)
    rows = site(rng, 30)
    portals = spark.createDataFrame([(HOME,)], "base_url string")
    listed = spark.createDataFrame([(rows[5][1],), (f"{HOME}/app/visits/note?noteid=1&csn=3",), (f" {HOME}/nowhere ",)], "url string")
    context = "" if case % 2 else "somebody"
    seeds = frontier.seeds(portals, listed, None, ["test-results", "visits"], context)
    budgets = [Budgets(broad=99), Budgets(pages=9), Budgets(broad=2), Budgets(records=8), Budgets(pages=25, broad=4)][case]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, records long, empty boolean")
    known = [(u, "", c) for _, u, *_ in rows[8:14] for c in ("test-results", "visits")]
    covered = frontier.classified(spark.createDataFrame(known, "url string, text string, category string"), context).select("identity_hash")
    visited = frame.where("page_id in (0, 5, 12)").select(source_url_key(F.col("url")).alias("url_key"))
    force, exhaustive = case == 4, case == 1
    want, reason = queued(spark, rows, seeds, {r[0] for r in covered.collect()}, {r[0] for r in visited.collect()}, budgets, context, exhaustive, force)
    run = crawl_job(frame, seeds, covered, visited, None, budgets, context, HOME, exhaustive, force)
    got = [(r["url"], r["status"]) for r in run.visits.orderBy("position").collect()]
    assert got == want and run.reason == reason and run.truncated == (reason != "queue_exhausted")
    assert run.visited().count() == len({u for u, s in want if s == "visited"})


def test_stored_records_cover_details(spark):
    rows = [(0, f"{HOME}/app/test-results", f'<a href="{HOME}/app/test-results/details?eorderid=1">Result</a><a href="{HOME}/app/test-results/details?eorderid=2">Result</a>', 0, False), (1, f"{HOME}/app/test-results/details?eorderid=1", "", 1, False), (2, f"{HOME}/app/test-results/details?eorderid=2", "", 1, False)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, records long, empty boolean")
    seeds = frontier.seeds(spark.createDataFrame([(HOME,)], "base_url string"), categories=["test-results"])
    stored = spark.createDataFrame([("test-results", "test-result", "CBC", "Value 1", rows[1][1])], "category string, record_type string, title string, raw_text string, source_url string")
    status = lambda run: {r["url"][-1]: r["status"] for r in run.visits.collect()}
    assert status(crawl_job(frame, seeds, stored=stored)) == {"s": "visited", "1": "skipped", "2": "visited"}
    # Forced, all is visited; where a patient is bound, stored addresses prove nothing.
    assert status(crawl_job(frame, seeds, stored=stored, force=True)) == {"s": "visited", "1": "visited", "2": "visited"}
    assert status(crawl_job(frame, frontier.seeds(spark.createDataFrame([(HOME,)], "base_url string"), categories=["test-results"], context="x"), stored=stored, context="x"))["1"] == "visited"


def test_runs_without_pages_or_seeds(spark):
    frame = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    seeds = frontier.seeds(spark.createDataFrame([(HOME,)], "base_url string"))
    run = crawl_job(frame, seeds)
    assert run.reason == "queue_exhausted" and {r["status"] for r in run.visits.collect()} == {"failed"} and run.links.count() == 0
    assert crawl_job(frame, seeds.limit(0)).visits.count() == 0


def test_budgets_cut_where_a_running_sum_does(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.random() < 0.3, rng.randrange(5)) for i in range(3000)]
    frame = spark.createDataFrame([(f"u{i:04}", p, i, i % 2 == 0, b, e) for i, p, b, e in rows], "url string, priority int, pos long, strict boolean, broad boolean, expected int").repartition(5)
    for pages_most, broad_most, records_most in ((10**9, 10**9, 10**9), (1234, 10**9, 10**9), (10**9, 200, 10**9), (10**9, 10**9, 3000), (0, 5, 5), (10**9, 0, 10**9)):
        ordered = sorted(rows, key=lambda r: (r[1], r[0] % 2, r[0]))
        want, n, b, e = [], 0, 0, 0
        for i, _, broad, gain in ordered:
            stop = "max_pages" if n >= pages_most else "max_records" if e >= records_most else "max_broad" if broad and b >= broad_most else ""
            want.append((f"u{i:04}", stop))
            if stop:
                break
            n, b, e = n + 1, b + broad, e + gain
        got = frontier.plan(frame, pages_most, broad_most, records_most).orderBy("position").collect()
        assert [(r["url"], r["stopped"]) for r in got] == want and [r["position"] for r in got] == list(range(1, len(want) + 1))
