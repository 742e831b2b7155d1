import random
from collections import Counter

import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.test_queries import SF, duck, rows_of  # noqa: F401

from orrery.llm import catalog


def test_sql_of_the_operators(spark, duck):  # noqa: F811
    for name, sql in catalog.ORACLE_SQL.items():
        got = catalog.QUERIES[name](spark, SF)
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        got = got.select(*columns)
        assert rows_of(got.collect(), columns) == rows_of(want.fetchall(), columns), name


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, SF)
        assert docs.columns == columns and 0 < docs.count() <= before
    assert corpus_pipeline.run(spark, SF).count() > 0


WORDS = {
    "en": "the and of water house river stone light morning people with from this that have been were their which would".split(),
    "de": "der und das wasser haus fluss stein licht morgen leute mit von dies nicht haben wurde waren ihre welche würde".split(),
    "ru": "и вода дом река камень свет утро люди была она с от это что имеют были их который бы не".split(),
}
SHARED = "a line that several of the people have in their house"
PASSAGE = "stone river water people morning light house the and of were which would have been"


def planted():
    """Documents (doc_id, text, lang) and what each stage makes of them: doc_id -> text."""
    rng = random.Random(9)
    some = lambda k, n: " ".join(rng.choice(WORDS[k]) for _ in range(n))
    docs = {i: (some(k, 60), k) for i in range(60) for k in [list(WORDS)[i % 3]]}
    docs[100], docs[101] = ("123 456 !?", None), (None, "en")  # no language
    docs[102] = (f"{some('en', 40)} {some('ru', 60)}", None)  # mixed, kept
    for i in (110, 111, 112):
        docs[i] = (f"{some('en', 30)}\n{SHARED}\n{some('en', 30)}", "en")
    for i in (115, 116):
        docs[i] = (SHARED, "en")  # loses all its text, as 117 keeps the line
    docs[117] = (f"{SHARED}\n{some('en', 30)}", "en")
    docs[120] = (some("de", 80), "de")
    docs[121] = (docs[120][0].replace(" ", "  "), "de")
    docs[122] = (docs[120][0] + " " + some("de", 2), "de")
    docs[130] = (f"{some('en', 60)} {PASSAGE} {some('en', 60)}", "en")
    docs[131] = (PASSAGE, "en")  # mostly benchmark text
    text = {i: t for i, (t, _) in docs.items()}
    after = [{i: t for i, t in text.items() if i not in (100, 101)}]
    lines = {i: "\n".join(x for x in t.split("\n") if x != SHARED or i == 117) for i, t in after[0].items()}
    after.append({i: t for i, t in lines.items() if t})
    words = {i: t.split() for i, t in after[1].items()}
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}
    parent = {i: i for i in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if b < a and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                ra, rb = parent[a], parent[b]
                parent = {i: min(ra, rb) if r in (ra, rb) else r for i, r in parent.items()}
    after.append({i: t for i, t in after[1].items() if parent[i] == i})
    cut = {i: " ".join(t.replace(PASSAGE, "").split()) for i, t in after[2].items()}
    after.append({i: t for i, t in cut.items() if t})
    return docs, after


def test_pipeline_stages_on_planted_documents(spark, tmp_path):
    docs, after = planted()
    rows = [(i, t, k, "x", len(t or "")) for i, (t, k) in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 121 not in after[2] and 122 not in after[2] and 120 in after[2] and 115 not in after[1]
    now = frame
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], after, strict=True):
        got = stage(spark, now, str(tmp_path)).collect()
        plain = (lambda t: " ".join(t.split())) if name == "benchmark_decontamination" else str
        assert {r.doc_id: plain(r.text) for r in got} == {i: plain(t) for i, t in want.items()}, name
        assert len(got) == len(want) and all(r.n_chars == len(r.text) and r.source == "x" for r in got), name
        now = spark.createDataFrame(got, frame.schema)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(after[-1])


CLASHES = ("score", "lang_pred", "spans", "rid", "kept", "x_id", "x_rid", "own_id", "lost_id", "row", "doc", "changed", "words", "h1", "batch", "__text", "__changed", "n_dropped", "component_id", "start")


def test_pipeline_stages_with_clashing_columns_odd_ids_and_no_rows(spark, tmp_path):
    docs, _ = planted()
    rows = [(i, t, k, "x", len(t or "")) for i, (t, k) in docs.items()]
    rows += [(None, f"{SHARED}\nand the water of the river that have been", "en", None, None), (None, None, None, None, None), (0, docs[0][0], "en", "x", 1), (3, "the house of the people", "en", "x", 23)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing = plain.select("*", *[F.lit(7).alias(c) for c in CLASHES])
    key = lambda df: sorted((tuple(r) for r in df.select(plain.columns).collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, clashing, str(tmp_path)), stage(spark, plain, str(tmp_path))
        assert got.columns == clashing.columns and want.columns == plain.columns
        assert key(got) == key(want), name
        assert got.where(" OR ".join(f"`{c}` <> 7" for c in CLASHES)).count() == 0, name
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0, name
        no_ids = [r for r in want.collect() if r.doc_id is None]
        assert len(no_ids) == {"language_id": 1, "benchmark_decontamination": 2}.get(name, 2), name
    packed = corpus_pipeline.STAGES[-1][1](spark, clashing, str(tmp_path))
    assert key(packed.select(F.col("doc_id"), F.col("length").alias("text"), F.lit(0).alias("lang"), F.lit(0).alias("source"), F.lit(0).alias("n_chars")))
    assert corpus_pipeline.STAGES[-1][1](spark, clashing.limit(0), str(tmp_path)).count() == 0


#: The columns that the contracts ask for, first and in this order.
CONTRACTS = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op2_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_queries_keep_their_contract(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    assert dict(f.split() for f in CONTRACTS[name].split(", ")).items() <= dict(got.dtypes).items()
    source = "pages" if name[:4] in ("op1_", "op4_") else "documents"
    ids = lambda df, c: Counter(r[0] for r in df.select(c).collect())
    want = spark.read.parquet(f"{SF}/{source}.parquet")
    key = want.columns[0]
    if name == "op9_packing":
        assert set(ids(got, key)) == set(ids(want, key))
    else:
        assert ids(got, key) == ids(want, key)
    if name == "op10_secret_scans":  # the base spans, again, in plain Python
        import hashlib
        import re

        assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
        of = {r.doc_id: r for r in got.collect()}
        for r in want.collect():
            t = r.text or ""
            base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
            base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
            base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
            spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base))
            assert of[r.doc_id].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
            assert [of[r.doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[3] == k for x in base) for k in ("assign", "access", "hex")]


def test_documents_in_several_languages_are_kept(spark):
    rng = random.Random(10)
    some = lambda k, n: " ".join(rng.choice(WORDS[k]) for _ in range(n))
    rows = [(i, some(k, 60), k) for i in range(60) for k in [list(WORDS)[i % 3]]]
    rows += [(100, f"{some('en', 40)} {some('de', 30)} {some('ru', 30)}", None), (101, "123 !?", None)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "")
    assert {r.doc_id for r in got.collect()} == {*range(60), 100}
