"""The training-data operators on small tables: nulls, empty and long texts,
ties, repeated rows, empty tables, clashing columns, and brute-force results."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import bpe, decontam, exact_dedup, html_extract, langid, mixing, quality, secrets, simhash, warc
from shelfloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity, and columns that clash with inner names."""
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "src1"), (3, "same text here now", "en", "src1"), (4, "same text here now", "en", "src2"),
        (4, "same text here now", "en", "src2"), (None, "same text here now", None, "src3"), (6, long, "de", "src4"), (7, long + " end", "de", "src4"),
        (8, "!!! ???", "fr", "odd"), (9, "token = \"0123456789abcdef0123456789\" x", "es", "src5"), (10, "\n\t ", "en", "src6"), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    return df.withColumns({"fp": F.lit("x"), "_id": F.lit(1), "_recipe": F.lit("r"), "score": F.lit(0.5), "tile": F.lit(2), "epoch": F.lit("e"), "spans": F.lit("s")})


def test_exact_dedup(odd):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.query(None, odd).collect()}
    assert {(3, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False), (6, 6, 1, True)} <= got
    empties = {r.doc_id: r.keep_id for r in exact_dedup.query(None, odd).collect() if r.group_size == 3}
    assert empties == {1: 2, 2: 2, None: 2}
    kept = exact_dedup.keep_largest(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == {2: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    alone = odd.filter("doc_id is null or doc_id = 7").withColumn("text", F.lit("one"))
    assert [r.doc_id for r in exact_dedup.keep_largest(alone).collect()] == [7]
    assert [r.doc_id for r in exact_dedup.keep_largest(alone.filter("doc_id is null")).collect()] == [None]
    assert exact_dedup.query(None, odd.limit(0)).count() == 0


def test_exact_dedup_with_colliding_hashes(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["red. ", "blue ", "old ", "seen "]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += texts[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weak = lambda c: F.length(c).cast("long") % 3
    got = {r._id: (r._keep, r._size) for r in exact_dedup.groups(docs, hasher=weak, cut="(?s).{8,40}?[.] |.{1,40}").collect()}
    last, n = {t: i for i, t in enumerate(texts)}, Counter(texts)
    assert got == {i: (last[t], n[t]) for i, t in enumerate(texts)}


def test_chunks_join_to_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    c = exact_dedup.chunks(F.col("text"))
    bad = docs.filter((F.array_join(c, "") != F.col("text")) | F.exists(c, lambda x: F.length(x) > exact_dedup.MAX_CHUNK))
    assert bad.count() == 0


def brute_components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= radius):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash_rows(odd):
    got = simhash.query(None, odd).collect()
    assert len(got) == odd.count()
    prints = [int(r.fingerprint, 16) for r in got]
    assert [r.component_id for r in got] == brute_components([r.doc_id for r in got], prints)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 10)} == {"0" * 16}
    assert simhash.query(None, odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == {i: 1 for i in (1, 3, 6, 8, 9)} | ({7: 1} if 7 in {r.component_id for r in got} else {})


@pytest.mark.parametrize("stage", ["simhash", "shingles"])
def test_one_row_of_each_near_group(spark, stage):
    """Rows are told apart by id and text, whatever ids repeat or are missing."""
    from shelfloom.llm import shingles

    keep = {"simhash": simhash.keep_one, "shingles": shingles.keep_one}[stage]
    a, b, c = ("alpha beta gamma delta eps zeta", "one two three four five six", "red green blue pink grey black")
    rows = [(1, a), (1, b), (0, b), (1, a), (None, a), (None, c), (None, c), (5, None), (4, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert rows_of(keep(docs).select("doc_id", "text")) == sorted([(1, a), (0, b), (None, c), (4, "")], key=repr)
    assert keep(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [8, 4096])
def test_simhash_links_lose_nothing(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base[:30]:
        at = int(b)
        for _ in range(12):
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                at ^= 1 << int(bit)
            prints.add(at)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    marked = spark.createDataFrame(list(enumerate(signed)), "_id long, fp long")
    edges = simhash.links(marked.select("fp"), 3, tile)
    from shelfloom.operators import graph

    root = {r.node: r.component for r in graph.components(edges, "u", "v").collect()}
    want = brute_components(list(range(len(prints))), prints)
    groups = defaultdict(set)
    for s, w in zip(signed, want):
        groups[w].add(s)
    for members in groups.values():
        assert len({root.get(m, m) for m in members}) == 1
    assert len({root.get(s, s) for s in signed}) == len(groups)


def test_decontamination(spark, odd):
    rows = [(1, "word100 word101 word102 word103 word104 word105 word106"), (2, None), (3, "no"), (None, "x"), (None, "word20000 word20001 word20002 word20003")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = rows_of(decontam.query(None, odd, items))
    assert got == [(6, 1, 1), (6, None, 1), (7, 1, 1), (7, None, 1)]
    marks = decontam.marked(odd.withColumn("_ITEMS", F.lit(1)), items)
    assert [c.lower() for c in marks.columns].count("_items") == 1
    assert decontam.query(None, odd, items.limit(0)).count() == 0
    clean = decontam.keep_clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = rows_of(decontam.query(None, docs, items))
    assert whole
    small = list(decontam.blocks(items, id_col="item_id", text_col="text", size=1500))
    assert len(small) > 3
    monkeypatch.setattr(decontam, "blocks", lambda *a, **k: iter(small))
    blocks = decontam.query(None, docs, items)
    assert rows_of(blocks) == whole
    assert "MapInArrow" not in blocks._jdf.queryExecution().executedPlan().toString()  # every pass is written
    monkeypatch.setattr(decontam, "blocks", lambda *a, **k: iter(small))
    assert decontam.keep_clean(docs, items).count() == docs.count() - len({r[0] for r in whole})


def test_token_counts(odd):
    got = {r.doc_id: r for r in bpe.query(None, odd, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert (got[1].n_tokens, got[1].n_bytes, got[2].n_tokens) == (0, 0, 0)
    assert got[7].over_limit and not got[3].over_limit and got[3].n_bytes == 18
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(got[r.doc_id].n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect() if r.doc_id)


def test_secrets(odd):
    got = {r.doc_id: r for r in secrets.query(None, odd).collect()}
    base = "assign:0:35,hex:9:35"
    assert got[9].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[9].spans == base  # the value is a keyboard walk
    assert (got[9].n_assign, got[9].n_hex, got[9].n_access) == (1, 1, 0)
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.query(None, odd.limit(0)).count() == 0


def test_html_without_its_article_tags(spark):
    """The paths decide, not the name of the container."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    renamed = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    same = sum(html_extract.extract(p) == html_extract.extract(q) for p, q in zip(pages, renamed))
    assert pages != renamed and same >= 0.98 * len(pages)


def test_html_and_warc_rows(spark):
    html = "<p>" + "A page, with text. " * 20
    rows = [(1, "u", None), (2, None, ""), (5, "u", html), (3, "u", html), (3, "u", html), (9, "u", "x"), (8, "u", "x"), (None, "u", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_first", F.lit(2))
    text = rows_of(html_extract.query(None, pages).select("page_id", "n_chars"))
    assert (1, 0) in text and (2, 0) in text and (5, 379) in text
    got = rows_of(warc.query(None, pages))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len(t or ""), digest(t), "revisit" if t == html and i != 3 else "response", 3 if t == html and i != 3 else None) for i, _, t in rows]
    assert got == sorted(want, key=repr)
    assert warc.query(None, pages.limit(0)).count() == 0 == html_extract.query(None, pages.limit(0)).count()


def test_warc_files(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    archives = warc.write_archives(pages, archive_bytes=20_000)
    members = warc.normalised(archives)
    warc.export_files(members, str(tmp_path))
    files = sorted(tmp_path.glob("*.warc.gz"))
    assert len(files) > 3
    n = 0
    for f in files:
        for line in open(f"{f}.idx"):
            offset, length, name, _ = line.split("\t")
            headers, _ = warc.read_at(f, int(offset), int(length))
            assert headers["WARC-Record-ID"] == name
            n += 1
    assert n == pages.count()
    # files on disk pass through the same operator
    again = spark.read.format("binaryFile").load(str(tmp_path / "*.warc.gz")).select(F.col("path").alias("archive"), "content")
    assert warc.read_members(warc.normalised(again)).count() == n


def test_classifiers_on_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1), (8, 0), (6, None), (7, 5)], "doc_id long, quality int")
    got = quality.query(None, odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in quality.query(None, odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns
    lang = {(r.doc_id, r.lang_pred) for r in langid.query(None, odd).collect()}
    assert {(1, "und"), (8, "und"), (10, "und")} <= lang
    assert {r.lang_pred for r in langid.query(None, odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.query(None, odd.limit(0)).count() == 0


def test_samples_are_bounded(spark):
    """One id, one row or one text may be any share of the table."""
    from shelfloom.llm import common

    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    docs = docs.union(spark.range(2000).select(F.lit(None).cast("long"), F.lit("ein text"), F.lit("de")))
    labels = spark.range(900).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("quality")).union(spark.range(50).select(F.col("id") + 5, F.lit(0)))
    docs = docs.union(spark.range(50).select(F.col("id") + 5, F.lit("!!!"), F.lit("en")))
    seen = []
    fit = common.capped
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "capped", lambda *a: (seen.append(fit(*a).count()), fit(*a))[1])
        weights, _ = quality.train(docs, labels, per_class=40)
    assert seen == [41, 80] and np.abs(weights).sum() > 0
    model = langid.train(docs, per_language=40)
    assert model.languages == ["de", "en"] and model.predict("ein text")[0] == "de" and model.predict("text number 7")[0] == "en"
    seen, rows = langid.document_frequencies(docs.withColumnRenamed("text", "_text"))
    assert rows == 5000 and seen.max() == 5000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    q = [r for r in Q.queries()["op3_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in q]) > 0.95
    x = [r for r in Q.queries()["op5_language_id"](spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in x]) > 0.97


def test_mixture(spark, odd):
    got = mixing.mixed(odd)
    assert set(got.columns) == {*odd.columns, "domain", "epoch", "n_tokens"}
    assert mixing.mixed(odd.limit(0)).count() == 0
    mix = mixing.Mix(domain={"d0": 1, "d1": 0}, share=(1, 1), epochs=2, other=1)
    rows = mixing.mixed(odd, mix).collect()
    assert all(r.domain != "d1" for r in rows) and max(r.epoch for r in rows) <= 2


def test_shortages_go_to_siblings_first(spark):
    # two domains of equal weight; in d0 one source is short and its sibling takes over
    rows = [(k, "w " * 100, "en", "src0") for k in range(2)] + [(k, "w " * 100, "en", "src4") for k in range(10, 60)] + [(k, "w " * 100, "en", "src1") for k in range(100, 160)]
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOCS)
    mix = mixing.Mix(domain={"d0": 1, "d1": 1}, share=(1, 2), epochs=1)
    n = Counter(r.source for r in mixing.mixed(docs, mix).collect())
    assert n == {"src0": 2, "src4": 26, "src1": 28}


@pytest.mark.parametrize("slot", [4, 1024])
def test_mixture_of_repeated_rows(spark, monkeypatch, slot):
    """Against the SQL, where a third of the rows share an id or id and text."""
    monkeypatch.setattr(mixing, "SLOT_ROWS", slot)
    rng = random.Random(6)
    rows = [(k if k % 3 else None, "w " * (k % 9 if k % 2 else 7), rng.choice(["en", "de", None]), f"src{k % 5}") for k in range(400)]
    rows += [(9, "w w w", "en", "src0")] * 120
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOCS).withColumns({"Epoch": F.lit("e"), "DOMAIN": F.lit("d"), "N_Tokens": F.lit("n")})
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = mixing.mixed(docs)
    assert len(got.columns) == len({c.lower() for c in got.columns}) == len(docs.columns)
    names = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens"]
    plain = lambda r: tuple(None if v is None or v != v else int(v) if isinstance(v, float) else v for v in r)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mixing.oracle().replace('CAST(doc_id AS VARCHAR)', 'CAST(CAST(doc_id AS BIGINT) AS VARCHAR)')})").fetchall()
    assert rows_of(got.select(*names)) == sorted((plain(r) for r in want), key=repr) and len(want) > 200


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.queries()[name](spark, SF)
    want = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    plain = lambda r: tuple(int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v for v in r)
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.select(*names)) == sorted((plain(r) for r in want.fetchall()), key=repr)


INNER = (
    "_id _text _n _lang _source _domain _key _order _slot _whole _part _end _start _sofar epoch domain n_tokens _gone _sha256 _items _items_0 "
    "_quality_score Score _digest _tie _cut _most _rows _times _stays _wanted _found _h _k fp _fp component_id spans score lang_pred _recipe _keep _doc _label _i _v item_id _leads _stays in_0 in_1 N_CHARS2"
).split()


def test_stages_carry_columns_with_inner_names(spark):
    docs, labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    stages = {
        "quality": lambda d: quality.keep_good(d, labels), "exact": exact_dedup.keep_largest, "near": simhash.keep_one,
        "decontaminate": lambda d: decontam.keep_clean(d, benchmark), "mix": mixing.mixed,
    }
    # names that differ in case alone cannot be told apart by name, so they are left out
    inner = [n for k, n in enumerate(INNER) if n.lower() not in [m.lower() for m in INNER[:k]]]
    clashing = docs.select("*", *[F.lit("mine").alias(n) for n in inner])
    for name, stage in stages.items():
        plain, got = stage(docs), stage(clashing)
        made = {"domain", "epoch", "n_tokens"} if name == "mix" else set()
        assert set(got.columns) == {*clashing.columns, *made}, name
        assert rows_of(got.select(*plain.columns)) == rows_of(plain), name
        own = [n for n in inner if n not in made]
        assert got.filter(F.array_min(F.array(*[F.col(n) == "mine" for n in own])) == F.lit(False)).count() == 0, name


def test_outputs_replace_columns_of_their_names(spark, odd):
    docs = odd.withColumns({"n_tokens": F.lit("mine"), "lang_pred": F.lit("mine"), "TEXT_OUT": F.lit("mine")})
    import public_tokenizers

    counted = bpe.with_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert counted.columns.count("n_tokens") == 1 and counted.filter("n_tokens is null").count() == 0
    assert secrets.with_spans(docs).filter(F.size("spans") > 0).count() == 1
    assert simhash.with_fingerprint(docs).select("fp").distinct().count() > 1
    assert decontam.marked(docs, docs.limit(0).select(F.lit(1).cast("long").alias("item_id"), "text"), name="fp").filter(F.size("fp") > 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, SF).cache()
        assert seen.columns == columns
        ids, old = ({r.doc_id for r in d.select("doc_id").collect()} for d in (seen, before))
        assert ids <= old and len(ids) > 0.5 * len(old), name
        if name == "exact_dedup":
            assert seen.select("text").distinct().count() == seen.count() == before.select("text").distinct().count()
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in Q.queries()["op3_quality_classifier"](spark, SF).collect()}
            assert ids == {i for i in old if scores[i] == 1}
        if name == "near_dedup":
            # five-word shingles, similarity 0.8: the stage's own rule, over all pairs
            assert ids == brute_near([(r.doc_id, r.text) for r in before.collect()])
        if name == "decontaminate":
            texts, items = {r.doc_id: r.text for r in before.collect()}, spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            runs = lambda t, n: {tuple(w[k : k + n]) for w in [decontam.plain(t).split()] for k in range(len(w) - n + 1)}
            short, long = (set().union(*(runs(r.text, n) for r in items)) for n in (6, 13))
            assert old - ids >= {i for i, t in texts.items() if runs(t, 13) & long}
            assert ids >= {i for i, t in texts.items() if not runs(t, 6) & short}
            assert old - ids
    assert P.STAGES[-1][1](spark, seen, SF).count() > 0


def shingle_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]


def brute_near(rows):
    """Smallest ids of the groups of (id, text), over all pairs."""
    sets, group = shingle_sets([t for _, t in rows]), [i for i, _ in rows]
    for j in range(len(rows)):
        for i in range(j):
            if sets[i] == sets[j] or (sets[i] | sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                least = min(group[i], group[j])
                group = [least if g in (group[i], group[j]) else g for g in group]
    return set(group)


@pytest.mark.parametrize("part", [3, 512])
def test_near_stage_finds_every_similar_pair(spark, monkeypatch, part):
    import corpus_pipeline as P
    from shelfloom.llm import shingles

    monkeypatch.setattr(shingles, "PART", part)

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 90, 250]))]
        for _ in range(rng.choice([1, 2, 3, 5, 12])):
            made = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                made[rng.randrange(len(made))] = word()
            texts.append(" ".join(made))
    texts += [None, "", " \n"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in P.near_stage(spark, docs, "").collect()} == brute_near(list(enumerate(texts)))
