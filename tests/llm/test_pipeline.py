"""The pipeline stage by stage against brute force, and run() against the stages."""

import numpy as np
import pytest

import corpus_pipeline
from fieldweave.llm import queries, secrets, tokens
from test_documents import SOUNDS, brute_groups, brute_repeats, spoken, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    langs = list(SOUNDS)
    rows = [(k, spoken(langs[k % 3], k, 30 + k), langs[k % 3], f"src{k % 4}") for k in range(60)]
    passage = spoken("aa", 999, 70)
    rows += [(100 + k, spoken("aa", 200 + k, 20) + "\n" + passage + " é " + spoken("aa", 300 + k, 20), "aa", "src0") for k in range(6)]
    near = spoken("bb", 555, 80).split()
    for k in range(5):
        t = list(near)
        t[k * 7] = "und"
        rows.append((200 + k, " ".join(t), "bb", "src1"))
    rows += [(300, None, "aa", None), (301, "", "bb", "src2"), (302, "123 %% 456", None, "src2"), (303, spoken("cc", 1, 30) + " token = abcdef123456 und", "cc", "src3"), (304, rows[5][1], "cc", "src3"), (304, rows[5][1], "cc", "src3"), (305, rows[7][1], "bb", "src3"), (None, spoken("aa", 77, 30), "aa", "src0")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(str(base / "documents.parquet"))
    docs, out = spark.read.parquet(str(base / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(base)).write.parquet(str(base / f"s{k}"))
        docs = spark.read.parquet(str(base / f"s{k}"))
        out.append(docs)
    return base, out


def rows(df):
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect()]


def key(r):
    return tuple(str(x) for x in r)


def test_language_keeps_what_has_letters(stages):
    want = [r for r in corpus() if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(rows(stages[1][0]), key=key) == sorted(want, key=key)


def test_one_of_each_group_stays(stages):
    before = rows(stages[1][0])
    groups = brute_groups([(i, t) for i, t, *_ in before if i is not None])
    want = {i for i, (_, c) in groups.items() if i == c}
    got = [r[0] for r in rows(stages[1][1])]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert all(r in before for r in rows(stages[1][1]))


def test_different_texts_of_one_id_stay(spark):
    a, b, c = (spoken(lang, 70 + k, 80) for k, lang in enumerate(SOUNDS))
    texts = [(1, a), (5, a + " und"), (5, b), (5, c), (5, c), (6, b + " und"), (7, a), (7, a), (None, a), (None, a), (8, None), (8, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], SCHEMA)
    want = sorted([(1, a), (5, b), (5, c), (None, a), (None, a), (8, None), (8, "")], key=key)
    for layout in (1, 5):
        got = corpus_pipeline.near_duplicates(spark, docs.repartition(layout), "")
        assert sorted([r[:2] for r in rows(got)], key=key) == want
    after = corpus_pipeline.repeats(spark, docs.where("doc_id < 6"), "")
    assert {(i, t) for i, t in texts if i in (1, 5) and not (t or "").startswith(a + " ")} <= {r[:2] for r in rows(after)}


def test_repeats_go_and_characters_stay_whole(stages):
    before = {r[0]: r for r in rows(stages[1][1])}
    want = brute_repeats([(i, r[1]) for i, r in before.items() if i is not None])
    after = {r[0]: r for r in rows(stages[1][2])}
    assert set(after) == set(before) and any(n for _, n, _, _ in want.values())
    for i, r in after.items():
        assert r[2:4] == before[i][2:4] and r[4] == len(r[1])
        if i is not None:
            size, gone, runs, _ = want[i]
            assert size - gone <= len(r[1].encode()) <= size - gone + 2 * 3 * runs


def test_secrets_are_redacted(stages):
    before, after = ({r[0]: r for r in rows(stages[1][k])} for k in (2, 3))
    for i, r in after.items():
        assert r[1] == secrets.redact(before[i][1], secrets.scan(before[i][1])) and r[4] == len(r[1])
    assert "[SECRET]" in after[303][1] and "abcdef123456" not in after[303][1]


def test_all_tokens_are_packed(stages):
    texts = {r[0]: r[1] for r in rows(stages[1][3])}
    sizes = {}
    for r in stages[1][4].collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(tokens.token_ids(t, tokens.vocabulary_path())) + 1 for i, t in texts.items()}


def test_run_gives_the_last_stage(spark, stages):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    keyed = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert keyed(queries.queries()["pipeline"](spark, str(stages[0]))) == keyed(stages[1][4])


CLASHING = ["_id", "_0", "n_bytes", "kept_text", "key", "nr", "sum", "cell", "component_id", "kept", "a.b", "score", "doc_id2"]


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_keep_columns_of_any_name(spark, repeated):
    texts = [(k, spoken("aa", k, 30), f"x{k}") for k in range(6)] + [(7, spoken("aa", 3, 30), "x7")] + ([(5, spoken("aa", 90, 30), "y"), (5, spoken("aa", 90, 30), "y")] if repeated else [])
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t), *[x] * len(CLASHING)) for i, t, x in texts], SCHEMA + "".join(f", `{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] + CLASHING, name
        got = {(r["doc_id"], *r[5:]) for r in docs.collect()}
        want = [(i, *[x] * len(CLASHING)) for i, _, x in texts if i != 7 or name == "language"]
        assert got == set(want), name
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, "").collect()} == {i for i, *_ in want}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert not np.any(words(0, 1))
