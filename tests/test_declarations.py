import pytest

from fieldweave.functions.declarations import parse, read_lines, read_tokens
from fieldweave.operators import catalog
from fieldweave.plans import queries as core
from fieldweave.sources.protofiles import scan_file, scan_folder, split_errors
from fieldweave.errors import NotFoundError

PROTO3 = """syntax = "proto3";
package shop.v1;
import "common.proto";
import public "other.proto";

// An order line
message Order {
  string name = 1; // the name
  int64 placed = 2;
  repeated string tags = 3;

  // carried over
  map< string ,int32 > sizes = 4;
  oneof pay {
    string card = 5;
    // inside
    bytes cash = 6;
  }
  enum State { 
    option allow_alias = true;
    NEW = 0;
    OLD = -1;
  }
  message Inner {
    uint32 pid = 1;
    message Deep {
      bool on = 1;
    }
  }
  Inner inner = 7;
}
enum Level {
  LOW = 0;
  HIGH = 2;
}
service Shop {
  rpc Send (Order) returns (Level.Reply);
  rpc Watch (stream Order) returns (stream Order);
}
"""


def fields(rows):
    return [(x["message_name"], x["parents"], x["name"], x["type"], x["number"], x["label"], x["comment"]) for x in sorted((r for r in rows if r["kind"] == "field"), key=lambda r: (r["msg_ord"], r["ord"]))]


def test_usual_file_both_modes():
    for read in (read_lines, read_tokens):
        syntax, package, imports, rows = read(PROTO3)
        assert (syntax, package) == ("proto3", "shop.v1")
        assert imports[0] == "common.proto"
        assert fields(rows) == [
            ("Order", [], "name", "string", 1, "optional", "the name"),
            ("Order", [], "placed", "int64", 2, "optional", ""),
            ("Order", [], "tags", "string", 3, "repeated", ""),
            ("Order", [], "sizes", "map<string, int32>", 4, "optional", "carried over"),
            ("Order", [], "card", "string", 5, "optional", ""),
            ("Order", [], "cash", "bytes", 6, "optional", "" if read is read_lines else "inside"),
            ("Order", [], "inner", "Inner", 7, "optional", ""),
            ("Inner", ["Inner"], "pid", "uint32", 1, "optional", ""),
            ("Deep", ["Inner", "Deep"], "on", "bool", 1, "optional", ""),
        ]
        enums = {r["name"]: r["values"] for r in rows if r["kind"] == "enum"}
        assert enums == {"State": [("NEW", 0), ("OLD", -1)], "Level": [("LOW", 0), ("HIGH", 2)]}
        rpcs = next(r["rpcs"] for r in rows if r["kind"] == "service")
        assert rpcs[0] == ("Send", "Order", "Level.Reply")
        assert len(rpcs) == (1 if read is read_lines else 2)  # compat drops streaming calls
        assert next(r["comment"] for r in rows if r["kind"] == "message") == "An order line"
    assert read_lines(PROTO3)[2] == ["common.proto"]


def test_proto2_labels_and_default_syntax():
    text = 'package audit;\nmessage AuditLog {\n  required string user = 1;\n  optional string description = 2;\n}\n'
    for read in (read_lines, read_tokens):
        syntax, _, _, rows = read(text)
        assert syntax == "proto2"
        assert [(f[2], f[5]) for f in fields(rows)] == [("user", "required"), ("description", "optional")]


@pytest.mark.parametrize(
    "text, compat, strict",
    [
        ("message A { string x = 1; }", [], ["x"]),  # declarations on the lines of the braces
        ("message A\n{\n  string x = 1;\n  message B {\n    string y = 1;\n  }\n}", ["y"], ["x", "y"]),  # brace on the next line
        ("message A {\n  // optional string x = 1;\n  string y = 2;\n}", ["x", "y"], ["y"]),  # commented out
        ("message A {\n  /*\n  string x = 1;\n  */\n  string y = 2;\n}", ["x", "y"], ["y"]),  # block comment
        ("message A {\n  optional group Item = 1 {\n    string x = 2;\n  }\n  string y = 3;\n}", ["Item", "x", "y"], ["item", "y"]),  # group
        ("message A {\n  reserved 2, 15;\n  extensions 100 to 199;\n  string y = 3 [deprecated = true];\n}", ["y"], ["y"]),
        ("message A {\r\n  string x = 1;\r\n}\r\n", ["x"], ["x"]),
        ("", [], []),
        ("message A {\n  string x = 1;\n", [], ["x"]),  # not closed: compat leaves out the last line
    ],
)
def test_modes_differ_where_documented(text, compat, strict):
    assert [f[2] for f in fields(read_lines(text)[3])] == compat
    assert [f[2] for f in fields(read_tokens(text)[3])] == strict


def test_label_words_in_types():
    text = "message A {\n  optional_kind x = 1;\n}"
    assert fields(read_lines(text)[3])[0][3:6] == ("_kind", 1, "optional")
    assert fields(read_tokens(text)[3])[0][3:6] == ("optional_kind", 1, "optional")


def test_comments_carry_over_blank_lines_in_bodies_only():
    text = "// lost\n\nmessage A {\n  // first\n  // second\n\n  string x = 1;\n  string y = 2;\n}"
    rows = read_lines(text)[3]
    assert [f[6] for f in fields(rows)] == ["second", ""]
    assert rows[0]["comment"] == ""


def test_scan_and_flatten(spark, tmp_path):
    (tmp_path / "b.proto").write_text(PROTO3)
    (tmp_path / "a.proto").write_text("")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "_c.proto").write_text("message C {\n  string z = 1;\n}")
    (tmp_path / "d.proto").write_bytes(b"\xff\xfe")
    files = scan_folder(spark, tmp_path)
    good, bad = split_errors(files)
    assert good.count() == 3 and [r["file_path"] for r in bad.collect()] == [str(tmp_path / "d.proto")]
    declared = parse(files)
    assert catalog.parsed_files(declared).count() == 3 and catalog.parse_errors(declared).count() == 1
    records = catalog.field_records(declared).orderBy("ord").collect()
    assert [r["ord"] for r in records] == list(range(10))
    assert [r["field_name"] for r in records][:3] == ["z", "name", "placed"]
    names = [r["q"] for r in catalog.field_records(declared).orderBy("ord").select(catalog.qualified_name().alias("q")).collect()]
    assert names[-2:] == ["Inner.pid", "Inner.Deep.on"]
    keys = {r["file_path"].split("/")[-1]: r["event_type"] for r in catalog.file_event_type(declared).collect()}
    assert keys == {"a.proto": "", "_c.proto": "/C", "b.proto": "shop.v1/Order"}
    found = {(r["measure"], r["key"]): r["n"] for r in catalog.summary(declared, catalog.field_records(declared)).collect()}
    assert found["total_files", ""] == 3 and found["total_fields", ""] == 10
    assert found["fields_per_event_type", "shop.v1/Order"] == 7 and found["fields_per_event_type", "C"] == 1
    assert found["type_distribution", "string"] == 4


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_are_not_broadcast(spark, sf_dir):
    """The table of parts is small, what is parsed from it isn't: by the files' size Spark would broadcast it."""
    declared = parse(core._part_files(spark, sf_dir))
    numbered = catalog.field_records(declared)
    assert "Broadcast" not in _plan(numbered)
    assert "Broadcast" not in _plan(catalog.summary(declared, numbered))
    assert sorted(r["ord"] for r in numbered.select("ord").collect()) == list(range(8 * 200))
    types = _plan(core.queries()["type_distribution"](spark, sf_dir))
    assert "Join" not in types and types.count("MapInPandas") == 1
    same = [{tuple(r) for r in catalog.summary(declared, x).collect()} for x in (numbered, catalog.unnumbered_records(declared))]
    assert same[0] == same[1]


def test_missing_paths(spark, tmp_path):
    with pytest.raises(NotFoundError):
        scan_file(spark, tmp_path / "no.proto")
    with pytest.raises(NotFoundError):
        scan_folder(spark, tmp_path / "no")
    (tmp_path / "none").mkdir()
    assert parse(scan_folder(spark, tmp_path / "none")).count() == 0


def test_remote_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.proto").write_text("message B {\n  string y = 1;\n}")
    (tmp_path / "a.proto").write_text(PROTO3)
    (tmp_path / "c.proto").write_bytes(b"\xff")
    declared = parse(scan_folder(spark, f"file://{tmp_path}"))
    assert catalog.parse_errors(declared).count() == 1
    assert [r["field_name"] for r in catalog.field_records(declared).orderBy("ord").collect()][-1] == "y"


def test_comment_far_above(spark):
    text = "message A {\n// note" + "\n" * 200 + "int32 f = 1;\n}\n"
    for read in (read_lines, read_tokens):
        assert [r["comment"] for r in read(text)[3] if r["kind"] == "field"] == ["note"]


def test_long_files_take_time_in_proportion():
    import time

    def took(n):
        text = "message A {\n" + "\n".join(f"  // c{i}\n  int32 f{i} = {i};" for i in range(n)) + "\n}\n"
        start = time.process_time()
        assert len(read_tokens(text)[3]) == n + 1 and len(read_lines(text)[3]) == n + 1
        return time.process_time() - start

    took(500)
    assert took(16_000) < 24 * max(took(1000), 0.01) * 3


def test_remote_folders_keep_empty_and_hidden_files(spark, tmp_path):
    for name, text in (("a.proto", "message A {\n}\n"), ("empty.proto", ""), (".hidden/b.proto", "message B {\n}\n"), ("_x/deep/c.proto", "message C {\n}\n"), ("d/.e.proto", "message E {\n}\n"), ("bad.proto", b"\xff"), ("other.txt", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    seen = []
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        rows = scan_folder(spark, folder).orderBy("file_ord").collect()
        seen.append({(r["file_path"].split(str(tmp_path))[1], r["content"], r["error"] is None) for r in rows})
        assert [r["file_ord"] for r in rows] == list(range(6))
    assert seen[0] == seen[1] and len(seen[0]) == 6
