"""The pipeline on the smallest tables."""

import itertools
from collections import Counter, defaultdict

import corpus_pipeline

from sheaf.llm import bpe, decontam, jaccard
from sheaf.llm.words import words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    texts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    judged, _, one, clean = texts
    assert set(clean) == set(one) and set(one) < set(judged)
    assert jaccard.join(docs.limit(0)).count() == 0
    assert decontam.digests(decontam.contamination(docs, benchmark)).where("contaminated").count() == 0
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    own = bpe.Bpe(bpe.word_vocabulary())
    assert set(last) == set(clean)
    for i, r in last.items():
        assert list(r["ids"]) == bpe.unpacked(own.packed(clean[i])) and r["n_tokens"] == len(r["ids"])


def test_run_gives_what_the_stages_give(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() > 100


def test_a_copied_document_survives(spark, sf):
    clean = "A heron waits by the quiet river at dawn\nThen it strikes and lifts a silver fish"
    bodies = [f"menu\nwords of page {i}: " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(20)]
    rows = [(i, body, "en", "host", len(body)) for i, body in enumerate(bodies + [clean] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    texts = [r["text"] for r in docs.collect()]
    assert texts.count(clean) == 1 and len(texts) == 21 and not any("menu" in t for t in texts)


def test_stages_by_brute_force(spark, sf):
    """Each stage behind the classifier, on its own input, document by document in Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    # Line dedup: of a source's different texts, what more than a tenth hold, and more than one.
    before = [r.asDict() for r in docs.collect()]
    holding, pages = defaultdict(Counter), defaultdict(set)
    for d in before:
        if d["source"] is not None and d["text"] is not None:
            pages[d["source"]].add(d["text"])
    for source, texts in pages.items():
        for t in texts:
            holding[source].update({x for x in t.split("\n") if x.strip(" ")})
    bad = {s: {x for x, k in c.items() if k > 1 and k / len(pages[s]) > 0.1} for s, c in holding.items()}
    want = {d["doc_id"]: d["text"] if d["text"] is None or not bad.get(d["source"]) else "\n".join(x for x in d["text"].split("\n") if x not in bad[d["source"]]) for d in before}
    out = stages["line_dedup"](spark, docs, sf)
    lined = {r["doc_id"]: r["text"] for r in out.collect()}
    assert lined == want and any(want[d["doc_id"]] != d["text"] for d in before)

    # Near duplicates: the smallest id of each group that links of 0.8 or more tie together.
    own = {i: words(t) for i, t in lined.items()}
    shingle = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {("no words", lined[i])} for i, w in own.items()}
    root = {i: i for i in own}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(own), 2):
        small, large = sorted((len(shingle[a]), len(shingle[b])))
        if small >= 0.8 * large:
            both = len(shingle[a] & shingle[b])
            if both >= 0.8 * (small + large - both):
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(out.collect(), docs.schema)
    one = stages["ngram_jaccard"](spark, frame, sf)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i in root if root[i] == i) and len(set(map(top, root))) < len(root)

    # Decontamination: words in any run of ten of a benchmark's go, until none is left.
    windows = {tuple(w[k : k + 10]) for w in map(words, items) for k in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(w) for w in windows}

    def clean(w):
        while True:
            hit = {k + j for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
            if not hit:
                return w
            w = [x for k, x in enumerate(w) if k not in hit]

    cleaned = {r["doc_id"]: r["text"] for r in stages["decontamination"](spark, frame, sf).collect()}
    assert {i: words(t) for i, t in cleaned.items()} == {i: clean(w) for i, w in own.items()}
    assert all(cleaned[i] == lined[i] for i, w in own.items() if clean(w) == w) and any(clean(w) != w for w in own.values())
