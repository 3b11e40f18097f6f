"""URLs: categories, keys, and canonical forms. What cannot be parsed takes the fallback that each function names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import let, or_empty

#: Ordered rules from words in a URL to a category. Fixed values.
CATEGORY_WORDS = [
    ("test-results", ["test-results", "testresults"]),
    ("medications", ["medication"]),
    ("visits", ["visit"]),
    ("letters", ["letter"]),
    ("billing", ["billing"]),
    ("allergies", ["allerg"]),
    ("immunizations", ["immuniz", "healthadvisories"]),
    ("health-summary", ["healthsummary", "health-summary"]),
]
#: Query parameters that identify a clinical item. Fixed values.
CLINICAL_IDS = ["component", "eorderid", "orderid", "resultid", "csn", "noteid", "hnoid", "hnodat", "lrpid", "dcsid"]


def category_from_url(url: Column) -> Column:
    low = F.lower(or_empty(url))
    out = F.when(low.rlike(r"\b(?:imaging|radiology|xray|x-ray|radiologyresult|diagnosticimaging)\b"), "imaging")
    for category, words in CATEGORY_WORDS:
        out = out.when(low.rlike("|".join(words)), category)
    return out.otherwise("general")


def parsed(url: Column) -> Column:
    """Whether an absolute URL can be parsed."""
    return F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("HOST")).isNotNull()


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def params(url: Column) -> Column:
    """Array of (name, value, at), in order; names and values as they stand."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    each = F.filter(F.split(query, "&", -1), lambda x: x != "")
    return F.transform(each, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("name"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("value"), i.alias("at")))


def param(url: Column, name: str) -> Column:
    """The first value of a parameter, decoded; null without it."""
    found = F.get(F.filter(params(url), lambda p: p["name"] == name), F.lit(0))["value"]
    return F.coalesce(F.try_url_decode(found), found)


def origin(url: Column) -> Column:
    """Scheme, host and port, in lower case."""
    authority = F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^[^@]*@", "")
    return F.lower(F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), authority))


def source_host(url: Column) -> Column:
    """Host with port; `invalid-url` where it cannot be parsed, '' for ''."""
    host = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^[^@]*@", ""))
    return F.when(or_empty(url) == "", "").when(parsed(url), host).otherwise("invalid-url")


def source_url_key(url: Column) -> Column:
    """Without the fragment; the text itself where it cannot be parsed. Only what may have a fragment is parsed."""
    raw = or_empty(url)
    return F.when(F.contains(raw, F.lit("#")), F.when(parsed(raw), F.regexp_replace(raw, "#.*$", "")).otherwise(raw)).otherwise(raw)


def _may_show(url: Column, part: str, found: Column, none: object) -> Column:
    """`found` of addresses that hold `part` of a path somewhere, else `none`: most are told by that and not parsed."""
    return F.when(F.contains(F.lower(or_empty(url)), F.lit(part)), found).otherwise(none)


def is_past_visit_detail(url: Column) -> Column:
    own = "/app/visits/past-details"
    return _may_show(url, own, F.lower(path(or_empty(url))).contains(own), False)


def is_visit_detail(url: Column) -> Column:
    return F.lower(path(or_empty(url))).rlike("/app/visits/(?:past-details|note)|visitdetails")


def visit_key(url: Column) -> Column:
    """Origin and visit number, for visit notes and past details; else ''."""
    csn = F.coalesce(param(url, "csn"), F.lit(""))
    here = F.lower(path(url)).rlike("/app/visits/(?:past-details|note)")
    return _may_show(url, "/app/visits/", F.when(here & (csn != ""), F.concat(origin(url), F.lit("/visit-csn/"), csn)).otherwise(""), "")


def canonical_source(url: Column) -> Column:
    """For comparing exports: no fragment, no parameter whose name starts with a presentation word, the rest by name."""
    return let(or_empty(url), _canonical)


def _canonical(raw: Column) -> Column:
    kept = F.filter(params(raw), lambda p: ~F.lower(p["name"]).rlike("^(?:utm_|tracking|from|view|tab|pagemode$)"))
    text = lambda p: F.concat(p["name"], F.lit("="), p["value"])
    # By name, and of one name by place.
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(p["name"].alias("name"), p["at"].alias("at"), text(p).alias("text"))))
    query = F.array_join(F.transform(ordered, lambda p: p["text"]), "&")
    base = F.regexp_replace(raw, r"[?#].*$", "")
    return F.when(~parsed(raw), raw).otherwise(let(query, lambda q: F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q))))


def route_identity(url: Column, category: Column, context: Column) -> Column:
    """What a route shows, whatever its address says else: origin, context, category, path, and clinical parameters by name; '' where it cannot be parsed."""
    return let(url, lambda u: identity_of(u, category, context))


def identity_of(url: Column, category: Column, context: Column) -> Column:
    """`route_identity` of an address that is a column: it is named more than once."""
    ids = F.filter(F.transform(params(url), lambda p: F.struct(F.lower(p["name"]).alias("name"), F.coalesce(F.try_url_decode(p["value"]), p["value"]).alias("value"))), lambda p: p["name"].isin(*CLINICAL_IDS, "action"))
    tail = F.transform(F.array_sort(ids), lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    head = F.array(origin(url), or_empty(context), or_empty(category), F.lower(F.regexp_replace(path(url), "/+$", "")))
    return F.when(parsed(url), F.array_join(F.concat(head, tail), "|")).otherwise("")


def normalize_detail_url(url: Column, category: Column) -> Column:
    """Past visit details are asked for with notes first; all else stays."""
    wanted = (category == "visits") & is_past_visit_detail(url) & param(url, "csn").isNotNull() & param(url, "pageMode").isNull()
    return F.when(wanted, F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("&pageMode=notesfirst"))).otherwise(or_empty(url))


def document_download_url(base: Column, document_id: Column, organisation: Column, given: Column) -> Column:
    """A document's address from its ids, else the given address (resolved if it is a path), else ''."""
    root = F.when(parsed(or_empty(base)), origin(base)).otherwise("")
    made = F.concat(root, F.lit("/app/documents/download?id="), F.url_encode(document_id), F.when(or_empty(organisation) != "", F.concat(F.lit("&org="), F.url_encode(organisation))).otherwise(""))
    plain = F.when(or_empty(given).startswith("/") & (root != ""), F.concat(root, given)).otherwise(or_empty(given))
    return F.when((or_empty(document_id) != "") & (root != ""), made).otherwise(plain)
