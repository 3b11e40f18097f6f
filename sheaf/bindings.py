"""The general test tables rendered as portal records, pages of text and links, so that the operators have something to recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PORTAL = "https://portal.example.org"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """A stored table's rows on all cores. What is rendered of a row is many times its size, and small files have fewer row groups than there are cores; a table of enough blocks stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(4 * cores)


def rendered_date(ts: Column, n: Column) -> Column:
    """A time in one of five styles."""
    styles = ["yyyy-MM-dd'T'HH:mm:ss", "M/d/yy", "M/d/yyyy h:mm a", "MMM dd, yyyy", "MMMM d, yyyy"]
    out = F.date_format(ts, styles[0])
    for k, style in enumerate(styles[1:], 1):
        out = F.when(F.pmod(n, F.lit(5)) == k, F.date_format(ts, style)).otherwise(out)
    return out


def _patient(key: Column, label: Column) -> Column:
    return F.struct(key.alias("key"), label.alias("name"), label.alias("label"), F.lit("").alias("relationship"))


def _records(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns of a record; what is not given is ''."""
    names = ["id", "category", "record_type", "title", "date", "summary", "raw_text", "clinical_text", "source_text", "source_url"]
    return df.select(*(columns.get(n, F.lit("")).alias(n) for n in names), columns["patient"].alias("patient"), columns.get("extracted_at", F.lit(None).cast("timestamp")).alias("extracted_at"), columns["seq"].cast("long").alias("seq"))


def rec_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _records(
        table(spark, sf_dir, "documents"),
        id=c("doc_id").cast("string"), patient=_patient(c("source"), c("source")), category=c("lang"), record_type=c("lang"), title=F.substring_index("text", "\n", 1), raw_text=c("text"),
        source_url=F.concat(F.lit(f"{PORTAL}/docs?id="), (c("doc_id") % 400).cast("string")), seq=c("doc_id"),
    )


def rec_events(spark: SparkSession, sf_dir: str, labs: bool = False) -> DataFrame:
    c = F.col
    kind = c("event_type")
    category = F.when(kind.isin("click", "view"), "test-results").otherwise(kind) if labs else kind
    return _records(
        table(spark, sf_dir, "events"),
        id=F.concat(F.lit("e"), c("event_id").cast("string")), patient=_patient(c("user_id").cast("string"), F.concat(F.lit("user "), c("user_id").cast("string"))), category=category, record_type=kind, title=kind, raw_text=c("props"),
        extracted_at=c("ts").cast("timestamp"), date=rendered_date(c("ts"), c("event_id")), source_url=F.concat(F.lit(f"{PORTAL}/"), kind, F.lit("?id="), c("user_id").cast("string"), F.lit("&view="), (c("event_id") % 3).cast("string")), seq=c("event_id"),
    )


def rec_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return _records(
        joined,
        id=c("o_orderkey").cast("string"), patient=_patient(c("o_custkey").cast("string"), c("c_name")), category=F.when(c("o_orderstatus") == "F", "test-results").otherwise("visits"), title=c("o_orderpriority"),
        date=rendered_date(c("o_orderdate"), c("o_orderkey")), raw_text=F.concat(F.lit("Order of "), c("c_name")), source_url=F.concat(F.lit(f"{PORTAL}/orders?id="), c("o_orderkey").cast("string")), seq=c("o_orderkey"),
    )


def cards(records: DataFrame) -> DataFrame:
    from sheaf.operators.records import index_card

    return index_card(records)


def lab_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lab text for each line item: `id`, `name`, `text`, with the columns it was made of."""
    c = F.col
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(c("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    value = c("l_quantity").cast("int").cast("string")
    text = F.concat_ws("\n", c("p_name"), F.concat(F.lit("Collected on "), F.date_format("l_shipdate", "MMM d, yyyy")), F.lit("Normal range: 1 - 25 units"), F.concat(F.lit("Value "), value, F.lit(" units"), F.when(c("l_quantity") > 25, " High").otherwise("")))
    return joined.select(F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("id"), c("p_name").alias("name"), text.alias("text"), "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


def note_text(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    """A visit note for each order with its line items, up to number `last` or all, as embedded lab groups: record columns."""
    c = F.col
    items = table(spark, sf_dir, "lineitem")
    if last is not None:
        items = items.where(c("l_linenumber") <= last)
    group = F.concat_ws("\n", F.concat(F.lit("Panel "), c("l_linenumber").cast("string")), F.concat(F.lit("Collection Time: "), F.date_format("l_shipdate", "MM/dd/yy"), F.lit(" 8:15 AM")), F.lit("Result Value Ref Range"), F.concat(F.lit("Item "), c("l_partkey").cast("string"), F.lit(" "), c("l_quantity").cast("int").cast("string"), F.lit(" mg/dL")))
    groups = items.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", group.alias("g")))), lambda x: x["g"]), "\n").alias("groups"))
    joined = table(spark, sf_dir, "orders").join(groups, "o_orderkey")
    text = F.concat_ws("\n", F.lit("Progress Notes by Staff"), F.lit("Recent Results"), c("groups"), F.lit("Assessment and Plan"), F.lit("Rest."))
    return _records(
        joined,
        id=F.concat(F.lit("n"), c("o_orderkey").cast("string")), patient=_patient(c("o_custkey").cast("string"), c("o_custkey").cast("string")), category=F.lit("visits"), record_type=F.lit("visit-note"), title=F.lit("Progress Notes by Staff"),
        date=F.date_format("o_orderdate", "MMM d, yyyy"), clinical_text=text, raw_text=text, source_url=F.concat(F.lit(f"{PORTAL}/app/visits/note?csn="), c("o_orderkey").cast("string")), seq=c("o_orderkey"),
    )


def letter_pages(spark: SparkSession, sf_dir: str, changed: str = "") -> DataFrame:
    """A portal's page for each order: `page_id`, `url`, `html` with a menu and a letter; letters of even orders say `changed`."""
    c, k = F.col, F.col("o_orderkey").cast("string")
    said = F.concat(F.lit("Provider note of order "), F.when(c("o_orderkey") % 2 == 0, changed).otherwise(""), k)
    html = F.concat(F.lit("<nav><li>Log out</li></nav><main><article>Letter about "), c("o_orderpriority"), F.lit("<br>"), F.date_format("o_orderdate", "MMM d, yyyy"), F.lit("<br>View<br>"), said, F.lit("</article></main><footer><li>Privacy policy</li></footer>"))
    return dealt(table(spark, sf_dir, "orders")).select(c("o_orderkey").alias("page_id"), F.concat(F.lit(f"{PORTAL}/app/letters/"), k).alias("url"), html.alias("html"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.initcap(c("p_name"))
    name = F.when(c("p_partkey") % 10 == 0, F.concat(name, F.lit(" Glucose"))).when(c("p_partkey") % 7 == 0, F.upper(name)).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(c("p_partkey") % 2 == 0, c("p_type")).otherwise("").alias("relationship"))


def portal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal links of six kinds: `id`, `kind`, `url`, `text`, `category`."""
    c, k = F.col, F.col("o_orderkey").cast("string")
    forms = [
        ("result", f"{PORTAL}/app/test-results/details?eorderid=", "Details", "test-results"),
        ("note", f"{PORTAL}/app/visits/note?noteid=7&csn=", "Clinical notes", "visits"),
        ("trend", f"{PORTAL}/app/test-results/past-result-details?orderid=", "Compare result trends", "test-results"),
        ("login", f"{PORTAL}/Authentication/Login?next=", "Sign in", "visits"),
        ("redirect", f"{PORTAL}/contentRedirect?orderid=", "Open", "test-results"),
        ("unknown", f"{PORTAL}/clinical/other?lrpid=", "More", "visits"),
    ]
    which = F.pmod(c("o_orderkey"), F.lit(6))
    pick = lambda i: F.get(F.array(*(F.lit(f[i]) for f in forms)), which.cast("int"))
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), pick(0).alias("kind"), F.concat(pick(1), k, F.lit("&view=full&from=home#top")).alias("url"), pick(2).alias("text"), pick(3).alias("category"))


def batches(spark: SparkSession, sf_dir: str, placed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Existing and incoming records of sources with seven events each; `placed` ones with the category and patient by which a store in parts lays them."""
    c = F.col
    who = c("user_id").cast("string")
    place = [c("event_type").alias("category"), _patient(who, who).alias("patient")] if placed else []
    base = table(spark, sf_dir, "events").select(c("event_id").cast("string").alias("id"), F.concat(F.lit(f"{PORTAL}/source?id="), (F.floor(c("event_id") / 7)).cast("string")).alias("source_url"), c("event_type").alias("title"), c("value"), *place, c("event_id").alias("n"))
    existing = base.where(c("n") % 10 < 8)
    incoming = base.where(((c("n") % 10 >= 6) & (c("n") % 100 < 50)) | (c("n") % 10 >= 8)).withColumn("value", F.when(c("n") % 3 == 0, c("value") + 1).otherwise(c("value")))
    return existing.drop("n"), incoming.drop("n")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of 500 pages that are read again and again: `seq` numbers a page's readings."""
    c = F.col
    source = F.concat(F.lit(f"{PORTAL}/page?id="), (c("event_id") % 500).cast("string"))
    who = c("user_id").cast("string")
    return table(spark, sf_dir, "events").select(c("event_id").cast("string").alias("id"), source.alias("source_url"), c("event_type").alias("title"), "value", c("event_type").alias("category"), _patient(who, who).alias("patient"), F.floor(c("event_id") / 2000).alias("seq"))


#: Rows of a file of arrivals; a task writes a file.
ARRIVAL_ROWS = 250_000


def arrivals(rows: DataFrame, folder: str, count: int) -> tuple[int, int]:
    """Rows by their `seq` as so many arrivals in a folder, one after another: how many files an arrival has, and all have. Rows of an arrival are dealt to its files, which tasks write side by side."""
    said = rows.agg(F.max("seq").alias("last"), F.count("*").alias("n")).first()
    last, files = (said["last"] or 0) + 1, max(1, -(-said["n"] // (count * ARRIVAL_ROWS)))
    for k in range(count):
        rows.where(F.floor(F.col("seq") * count / last) == k).repartition(files, "id").write.mode("append").parquet(folder)
    return files, len(rows.sparkSession.read.schema(rows.schema).parquet(folder).inputFiles())


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portal's site with a page for each order but the first, which is its list of results: each leads to eight others, every seventh only by an address of a route that is not recognised; some of what it leads to is not there."""
    c, k = F.col, F.col("o_orderkey")

    def address(n: Column) -> Column:
        plain = F.concat(F.lit(f"{PORTAL}/app/test-results/details?eorderid="), n.cast("string"))
        other = F.concat(F.lit(f"{PORTAL}/clinical/result/more?orderid="), n.cast("string"))
        return F.when(n == 0, f"{PORTAL}/app/test-results").when(n % 7 == 3, other).otherwise(plain)

    anchor = lambda n: F.concat(F.lit('<li><a href="'), address(n), F.lit('">Result details</a></li>'))
    more = F.array_join(F.transform(F.sequence(k * 8 + 1, k * 8 + 8), anchor), "")
    html = F.concat(F.lit("<main><ul>"), more, anchor(F.greatest(F.floor((k - 1) / 8), F.lit(0))), F.lit(f'<li><a href="{PORTAL}/app/test-results/past-result-details?orderid=1">View trends</a></li></ul></main>'))
    return dealt(table(spark, sf_dir, "orders")).select(k.alias("page_id"), address(k).alias("url"), html.alias("html"))


def portal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portal's page for each order, of four kinds: a list of two results, a note in a frame and a shadow tree under a header of its page, a result's detail, and a page where nothing looks like a record."""
    c, k = F.col, F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "MMM d, yyyy")
    link = lambda n: F.concat(F.lit(f'<div class="line"><div><a href="{PORTAL}/app/test-results/details?eorderid='), k, F.lit(f'-{n}"><div>Lab</div><div>Panel {n} of order '), k, F.lit("</div></a></div><div>"), day, F.lit("</div><div>Final result</div></div>"))
    listed = F.concat(F.lit("<nav><ul><li>Log out</li></ul></nav><main><div>"), link(1), link(2), F.lit("</div></main>"))
    inner = F.concat(F.lit("<p>Chief Complaint</p><p>Fever of order "), k, F.lit("</p>"))
    framed = F.concat(F.lit("<main><div>Notes from Care Team</div><div>Progress Notes</div><div>Signed "), day, F.lit('</div><iframe srcdoc="'), F.replace(F.replace(inner, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"></iframe><div><template shadowrootmode="open"><p>Plan: rest</p></template></div></main>'))
    detail = F.concat(F.lit("<main><h1>Panel of order "), k, F.lit("</h1><p>Collected on "), day, F.lit("</p><table><tr><td>Sodium</td><td>Value 140</td></tr></table></main>"))
    plain = F.concat(F.lit("<body><ul><li>Menu</li></ul><p>Order "), k, F.lit("</p></body>"))
    kind = F.pmod(c("o_orderkey"), F.lit(4)).cast("int")
    forms = [("/app/test-results?list=", listed), ("/app/visits/note?csn=", framed), ("/app/test-results/details?eorderid=", detail), ("/app/letters?id=", plain)]
    pick = lambda values: F.get(F.array(*values), kind)
    return dealt(table(spark, sf_dir, "orders")).select(c("o_orderkey").alias("page_id"), F.concat(pick([F.lit(PORTAL + u) for u, _ in forms]), k).alias("url"), pick([h for _, h in forms]).alias("html"))
