import http.server
import json
import threading

import numpy as np
import pytest

from fieldweave import cli
from fieldweave.errors import DataAccessError, ProcessingError, ValidationError
from fieldweave.operators import catalog, concepts, models, neighbours, review
from fieldweave.operators.embedding import hashed_ngrams
from fieldweave.operators.ingest import ingest
from fieldweave.operators.store import FieldStore
from fieldweave.schemas import CONCEPT, FIELD_RECORD
from fieldweave.sources import registry_files

RECORDS = [(n, t, m, "sink", f"{m}.proto", "optional", "", []) for n, t, m in (("userprincipalname", "string", "AlertsEnriched"), ("username", "string", "AppEnriched"), ("_tenant_id", "int64", "AlertsEnriched"))]
TWO = [
    ("user_identity", 0, "who", "user_principal_name", "string", [("sink/AlertsEnriched", "userprincipalname", "string", ""), ("sink/AppEnriched", "username", "string", "")], []),
    ("tenant_identifier", 1, "tenant", "_tenant_id", "int64", [("sink/AlertsEnriched", "_tenant_id", "int64", "")], []),
]


def records(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FIELD_RECORD)


def field(name, kind):
    return (name, kind, "NewEvent", "new", "new.proto", "optional", "", [])


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(TWO, CONCEPT)


def issues_of(spark, registry, rows, event):
    hits = spark.createDataFrame([], review.HITS)
    return [(r["field_name"], r["issue_type"], r["severity"]) for r in review.find_issues(records(spark, rows), hits, registry, event).orderBy("ord").collect()]


def test_issues(spark, registry):
    assert issues_of(spark, registry, [field("username", "string")], "new/NewEvent") == [("username", "naming_mismatch", "warning"), ("", "missing_concept", "warning")]
    assert issues_of(spark, registry, [field("_tenant_id", "string")], "new/NewEvent") == [("_tenant_id", "type_mismatch", "error"), ("", "missing_concept", "warning")]
    assert issues_of(spark, registry, [field("description", "string")], "new/NewEvent") == [("", "missing_concept", "warning")] * 2
    assert issues_of(spark, registry, [field("userprincipalname", "string"), field("_tenant_id", "int64")], "sink/AlertsEnriched") == [("userprincipalname", "naming_mismatch", "warning")]
    assert issues_of(spark, registry, [field("description", "string")], "") == []


def test_close_neighbour_without_concept(spark, registry):
    meta = ("descr", "string", "M", "p", "m.proto", "optional", "descr")
    hits = spark.createDataFrame([("description", 1, "i", 0.3, "d", meta), ("description", 2, "j", 0.4, "d", meta)], review.HITS)
    row = review.find_issues(records(spark, [field("description", "string")]), hits, registry, "").collect()
    assert len(row) == 1 and row[0]["severity"] == "info" and len(row[0]["similar_fields"]) == 2
    assert "similar to 'descr' in M (p)" in row[0]["message"]
    far = spark.createDataFrame([("description", 1, "i", 0.5, "d", meta)], review.HITS)
    assert review.find_issues(records(spark, [field("description", "string")]), far, registry, "").count() == 0


def test_first_concept_wins_over_exact_name(spark, registry):
    meta = ("username", "string", "M", "p", "m.proto", "optional", "username")
    hits = spark.createDataFrame([("_tenant_id", 1, "i", 9.0, "d", meta)], review.HITS)
    found = review.match_concepts(records(spark, [field("_tenant_id", "int64")]), hits, registry).collect()
    assert [r["concept"] for r in found] == ["user_identity"]


def test_end_to_end(spark, registry, tmp_path):
    store = FieldStore(spark, tmp_path / "store")
    assert store.upsert(records(spark, RECORDS)) == 3
    path = tmp_path / "newevent.proto"
    path.write_text('syntax = "proto3";\npackage newevent;\nmessage NewEvent {\n  string user_name = 1;\n  string _tenant_id = 2;\n  int64 timestamp = 3;\n}\n')
    r = review.run_review(spark, store, registry, path)
    assert (r.issue_count, r.error_count, r.warning_count, r.info_count) == (5, 1, 4, 0)
    found = [(x["severity"], list(x["fields"])) for x in r.recommendations.orderBy("ord").collect()]
    assert found == [("warning", ["user_name", "_tenant_id", "timestamp"]), ("error", ["timestamp"]), ("warning", [])]
    assert json.loads(review.as_json(r))["issue_count"] == 5
    assert "## !!! Field type mismatches" in review.as_markdown(r)
    assert "[ERROR] Field type mismatches" in review.as_text(r)
    said = []
    advised = review.run_review(spark, store, registry, path, adviser=lambda text: said.append(text) or '```json\n[{"title": "t", "fields": ["a"]}]\n```')
    assert [tuple(x) for x in advised.recommendations.collect()] == [(0, "t", "", "info", ["a"])]
    assert "- [ERROR] type_mismatch:" in said[0]


def test_recommendations(spark):
    schema = "ord bigint, field_name string, issue_type string, severity string, message string"
    rows = [(0, "a", "naming_mismatch", "warning", "m0"), (1, "b", "naming_mismatch", "info", "m1"), (2, "c", "odd", "info", "m2")]
    out = review.recommend(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in out] == [(0, "Field naming inconsistencies", "- m0\n- m1", "warning", ["a", "b"])]
    assert review.recommend(spark.createDataFrame([], schema)).count() == 0
    mild = spark.createDataFrame([rows[1]], schema)
    assert review.should_retry(mild, 0) and not review.should_retry(mild, 2) and not review.should_retry(spark.createDataFrame(rows, schema), 0)


def test_store(spark, tmp_path):
    store = FieldStore(spark, tmp_path / "s")
    assert store.count() == 0 and store.upsert(records(spark, [])) == 0
    assert store.similar_fields("x").count() == 0
    rows = [*RECORDS, ("user", "string", "X", "sink", "x.proto", "optional", "", [])]
    assert store.upsert(records(spark, rows)) == 4 and store.count() == 4
    assert store.upsert(records(spark, rows)) == 4 and store.count() == 4
    hits = store.by_concept("user identity").collect()
    assert len(hits) == 4 and hits[0]["metadata"]["field_name"] != "_tenant_id"
    assert [h["rank"] for h in hits] == [1, 2, 3, 4]
    twice = [rows[0], (*rows[0][:1], "bytes", *rows[0][2:])]  # one id twice: the last wins
    assert store.upsert(records(spark, twice)) == 2 and store.count() == 4
    assert store.all_fields().where("metadata.field_type = 'bytes'").count() == 1
    assert store.upsert(records(spark, rows[:1]), prune=True) == 1 and store.count() == 1
    store.clear()
    assert store.count() == 0


def test_embedding_order():
    a, b, c = hashed_ngrams(["user name", "username", "tenant identifier"])
    assert a @ b > a @ c and abs(float(a @ a) - 1) < 1e-6 and not hashed_ngrams([""]).any()


def test_top_k_keeps_filter_above_rank(spark):
    cat = spark.createDataFrame([(str(i), [float(i)], "f" if i < 3 else "g") for i in range(6)], "id string, embedding array<float>, file string")
    hits = neighbours.top_k(spark.createDataFrame([("q", [0.0])], "query_key string, embedding array<float>"), cat, 4, carry=("file",))
    assert [r["id"] for r in hits.orderBy("rank").collect()] == ["0", "1", "2", "3"]
    assert neighbours.drop_own_file(hits, "f", "file").count() == 1
    assert "WindowGroupLimit" in hits._jdf.queryExecution().toString()


def test_top_k_in_cells_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = [(k, rng.integers(0, 4, 3 if k % 5 else 2).astype(float).tolist() if k % 17 else None, f"f{k % 3}") for k in range(300)]
    cat = spark.createDataFrame(vectors, "id bigint, embedding array<float>, file string")
    asked = cat.where("id < 60").selectExpr("cast(id as string) AS query_key", "embedding")
    seen = []
    for block, members in ((2000, 20_000), (7, 20_000), (20, 31)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "MEMBERS", members)
        seen.append(sorted(tuple(r) for r in neighbours.top_k(asked, cat, 4, carry=("file",)).collect()))
    brute = []
    for q in range(60):
        if (v := vectors[q][1]) is not None:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i, f) for i, w, f in vectors if w is not None and len(w) == len(v))[:4]
            brute += [(str(q), r, i, d, f) for r, (d, i, f) in enumerate(near, 1)]
    assert seen[0] == seen[1] == seen[2] == sorted(brute)
    assert neighbours.top_k(asked.where("false"), cat, 4).count() == 0


def test_second_writer_is_refused(spark, tmp_path):
    store = FieldStore(spark, tmp_path / "s")
    store.upsert(records(spark, RECORDS))
    before = store.documents()
    since = store._versions()
    store.upsert(records(spark, RECORDS[:1]), prune=True)
    with pytest.raises(DataAccessError, match="STORE_CONFLICT"):
        store._replace(before, since)
    assert store.count() == 1 and before.count() == 3
    store.upsert(records(spark, RECORDS))
    assert len(list((tmp_path / "s").glob("v-*"))) == 2


def test_missing_concepts_of_all_event_types(spark, registry):
    rows = records(spark, [*RECORDS, ("other", "string", "Z", "zone", "z.proto", "optional", "", [])])
    got = {(r["event_type"], r["name"]) for r in review.missing_by_event_type(rows, registry).collect()}
    types = [r["event_type"] for r in catalog.event_types(rows).collect()]
    one_by_one = {(t, c) for t in types for c in (m.split("'")[3] for m in (r["message"] for r in review.missing_concepts(rows.where(catalog.event_type_key() == t), registry, t).collect()))}
    assert got == one_by_one and ("zone/Z", "user_identity") in got


class Endpoint(http.server.BaseHTTPRequestHandler):
    """A chat model that fails once, then answers what it was asked to."""

    asked: list = []

    def do_POST(self):
        said = json.loads(self.rfile.read(int(self.headers["content-length"])))
        Endpoint.asked.append((said, self.headers["authorization"]))
        self.send_response(503 if len(Endpoint.asked) == 1 else 200)
        self.end_headers()
        if len(Endpoint.asked) > 1:
            text = "" if "messages" not in said else '```json\n[{"name": "c", "mappings": [{"field_name": "user"}]}]\n```' if "Fields:" in said["messages"][1]["content"] else '[{"title": "t"}]'
            body = {"choices": [{"message": {"content": text}}]} if len(Endpoint.asked) % 2 else {"content": [{"text": text}]}
            self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


def test_hosted_models(spark, monkeypatch):
    server = http.server.HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("FIELDWEAVE_MODEL_URL", f"http://127.0.0.1:{server.server_port}/chat")
    monkeypatch.setenv("FIELDWEAVE_API_KEY", "k")
    clusterer, adviser = (cli._named(table, "some-model", hosted) for table, hosted in ((cli.CLUSTERERS, models.ChatClusterer), (cli.ADVISERS, models.ChatAdviser)))
    found, _ = concepts.build_registry(records(spark, RECORDS), clusterer)
    assert [r["name"] for r in found.collect()] == ["c"]
    assert json.loads(adviser("issues")) == [{"title": "t"}]
    assert len(Endpoint.asked) == 3  # one failure, one batch asked once, one review
    said, key = Endpoint.asked[-1]
    assert said["model"] == "some-model" and key == "Bearer k"
    review_ = review.Review("x.proto", None, spark.createDataFrame([(0, "t", "b", "info", [])], "ord int, title string, body string, severity string, fields array<string>"), 1, 0, 0, 1)
    Endpoint.asked.append(None)
    assert review.post_comment(review_, f"http://127.0.0.1:{server.server_port}/comments", "k") == 200
    assert Endpoint.asked[-1][0]["body"].startswith("# Proto Review: x.proto")
    server.shutdown()
    with pytest.raises(ProcessingError, match="COMMENT_FAILED"):
        review.post_comment(review_, "http://127.0.0.1:9/none")
    with pytest.raises(ProcessingError, match="MODEL_CALL_FAILED"):
        models.ChatModel("http://127.0.0.1:9/none", "m", tries=1).ask("a", "b")
    with pytest.raises(ProcessingError, match="MODEL_ANSWER_UNKNOWN"):
        models.ChatModel._text({"other": 1})
    monkeypatch.delenv("FIELDWEAVE_MODEL_URL")
    with pytest.raises(ValidationError, match="MISSING_MODEL_URL"):
        cli._named(cli.ADVISERS, "some-model", models.ChatAdviser)


def test_sentence_model_pools_its_tokens(monkeypatch):
    class Code:
        def __init__(self, n):
            self.ids, self.attention_mask, self.type_ids = [1, 2, 3], [1] * n + [0] * (3 - n), [0, 0, 0]

    class Input:
        def __init__(self, name):
            self.name = name

    class Session:
        def get_inputs(self):
            return [Input("input_ids"), Input("attention_mask")]

        def run(self, _, fed):
            assert set(fed) == {"input_ids", "attention_mask"}
            return [np.broadcast_to(np.array([[3.0, 0], [0, 4.0], [9, 9]]), (len(fed["input_ids"]), 3, 2))]

    class Tokens:
        def encode_batch(self, texts):
            return [Code(len(t)) for t in texts]

    monkeypatch.setattr(models, "_sentence_model", lambda folder: (Tokens(), Session()))
    out = models.SentenceEmbedder("/x", batch=2)(["a", "ab", "a"])
    assert np.allclose(out, [[1, 0], [0.6, 0.8], [1, 0]]) and out.dtype == np.float32


def test_bad_answers_are_logged(spark, caplog):
    with caplog.at_level("WARNING"):
        found, _ = concepts.build_registry(records(spark, RECORDS), lambda lines, types: "sorry, " + "x" * 500)
    assert found.count() == 0
    assert "batch 0" in caplog.text and "x" * 100 in caplog.text and "x" * 200 not in caplog.text


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "batch bigint, answer string")


def test_answers_and_merge(spark):
    one = json.dumps([{"name": "c", "description": "first", "mappings": [{"event_type": "e", "field_name": "f"}], "gaps": ["y", "x"]}])
    two = "```json\n" + json.dumps([{"name": "c", "description": "second", "mappings": [{"field_name": "g"}], "gaps": ["x", "a"]}, {"name": "d"}]) + "\n```"
    out = concepts.merge_batches(concepts.parse_answers(answers(spark, one, two, "no json", "```x", '{"name": 1}'))).orderBy("concept_ord").collect()
    assert [r["name"] for r in out][:2] == ["c", "d"]
    assert out[0]["description"] == "first" and out[0]["gaps"] == ["a", "x", "y"]
    assert [tuple(m) for m in out[0]["mappings"]] == [("e", "f", "", ""), ("", "g", "", "")]
    assert out[1]["canonical_name"] == "" and out[1]["mappings"] == []
    assert concepts.parse_answers(answers(spark, "no json")).count() == 0


def test_build_in_batches(spark):
    rows = [field(f"f{i}", "string") for i in range(250)]
    sizes = {r["batch"]: len(r["lines"]) for r in concepts.batches(records(spark, rows)).collect()}
    assert sizes == {0: 100, 1: 100, 2: 50}
    found, meta = concepts.build_registry(records(spark, [*RECORDS, ("userName", "int32", "Y", "sink", "y.proto", "optional", "", [])]))
    assert meta["total_fields"] == 4 and meta["total_event_types"] == 3 and meta["total_concepts"] == 1
    assert found.first()["name"] == "user_name"


def test_overrides_and_files(spark, registry, tmp_path):
    (tmp_path / "o.yaml").write_text("user_identity:\n  canonical_name: uid\nnew_one:\n  gaps: [a]\n")
    merged = concepts.merge_overrides(registry, registry_files.read_overrides(spark, tmp_path / "o.yaml"))
    assert [(r["name"], r["canonical_name"], r["concept_ord"]) for r in merged.orderBy("concept_ord").collect()] == [("user_identity", "uid", 0), ("tenant_identifier", "_tenant_id", 1), ("new_one", "", 3)]
    assert registry_files.read_overrides(spark, tmp_path / "none.yaml") is None
    for kind in ("yaml", "json"):
        path = tmp_path / "deep" / f"r.{kind}"
        assert registry_files.write_registry(registry, path, kind) == 2
        back = registry_files.read_registry(spark, path).orderBy("concept_ord").collect()
        assert [r["name"] for r in back] == ["tenant_identifier", "user_identity"]
        assert len(back[1]["mappings"]) == 2 and back[1]["mappings"][0]["file_path"] == ""
    with pytest.raises(ValidationError, match="INVALID_FORMAT"):
        registry_files.write_registry(registry, tmp_path / "r.xml", "xml")
    with pytest.raises(DataAccessError, match="REGISTRY_NOT_FOUND"):
        registry_files.read_registry(spark, tmp_path / "gone.yaml")
    for text, code in (("a: [", "INVALID_YAML"), ("- a", "INVALID_REGISTRY_FORMAT"), ("a: 3", "INVALID_REGISTRY_FORMAT")):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValidationError, match=code):
            registry_files.read_overrides(spark, tmp_path / "bad.yaml")
    for text, code in (("a: [", "INVALID_YAML"), ("- a", "INVALID_REGISTRY_FORMAT"), ("", "INVALID_REGISTRY_FORMAT")):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValidationError, match=code):
            registry_files.read_registry(spark, tmp_path / "bad.yaml")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("FIELDWEAVE_STORE_DIR", str(tmp_path / "store"))
    monkeypatch.setenv("FIELDWEAVE_REGISTRY_DIR", str(tmp_path / "registry"))
    protos = tmp_path / "protos"
    protos.mkdir()
    for name in ("A", "B"):
        (protos / f"{name}.proto").write_text(f'syntax = "proto3";\npackage p;\nmessage {name} {{\n  string user_name = 1;\n  int64 at = 2;\n}}\n')
    assert cli.main(["export-registry"], spark) == 1
    assert cli.main(["ingest", "--proto-dir", str(protos)], spark) == 0
    assert "Ingested 4 fields from 2 files" in capsys.readouterr().out
    assert cli.main(["build-registry", "--proto-dir", str(protos)], spark) == 0
    assert cli.main(["export-registry", "--format", "json"], spark) == 0
    assert sorted(json.loads((tmp_path / "registry" / "canonical_fields.json").read_text())) == ["at", "user_name"]
    capsys.readouterr()
    assert cli.main(["review", str(protos / "A.proto"), "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["error_count"] == 1
    assert cli.main(["ingest", "--proto-dir", str(tmp_path / "none")], spark) == 2
    result = ingest(spark, protos, FieldStore(spark, tmp_path / "other"))
    assert (result.total_files, result.total_fields, result.errors) == (2, 4, [])


def test_ingest_reports_all_unreadable_files(spark, tmp_path):
    protos = tmp_path / "protos"
    protos.mkdir()
    (protos / "A.proto").write_text('syntax = "proto3";\npackage p;\nmessage A {\n  string user_name = 1;\n}\n')
    for k in range(1010):
        (protos / f"bad{k:04}.proto").write_bytes(b"message \xff\xfe {")
    result = ingest(spark, protos, FieldStore(spark, tmp_path / "store"))
    assert (result.total_files, result.total_fields) == (1, 1)
    assert [e["file_path"].rsplit("/", 1)[-1] for e in result.errors] == [f"bad{k:04}.proto" for k in range(1010)]
