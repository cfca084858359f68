from __future__ import annotations

import json

from tallyline.operators import cases
from tallyline.sources import sinks
from tallyline.sources.tables import SCHEMAS, check_values, read_table, read_uploads, schema, with_neutral_names
from tests.conftest import one, rows_of


def test_every_layout_parses(spark):
    assert len(schema("rule_hit")) == 24 and len(schema("report_transformation_reconciliation")) == 31
    for name in SCHEMAS:
        assert schema(name).fieldNames()


def test_system_names_in_columns_become_neutral(frame):
    df = frame("distinct_rule_hits_count_crm INT, missed_rule_hits_count_ledger INT, rule_hit_publish_count_crm INT, source_crm INT", [(1, 2, 3, 4)])
    assert with_neutral_names(df, "crm", "ledger").columns == [
        "distinct_rule_hits_count_source", "missed_rule_hits_count_target", "rule_hit_publish_count_source", "source_crm"
    ]


def test_text_formats_use_the_declared_layout(spark, make, tmp_path):
    t = make("attempts_by_surrogate_key", [dict(attempt_id=1, txn_sur_key="007")])
    sinks.write_csv(t, str(tmp_path / "c"))
    t.write.json(str(tmp_path / "j"))
    t.write.parquet(str(tmp_path / "p"))
    t.write.orc(str(tmp_path / "o"))
    name = "attempts_by_surrogate_key"
    for fmt, where, options in (("csv", "c", {"header": "true"}), ("json", "j", {}), ("parquet", "p", {}), ("orc", "o", {})):
        back = read_table(spark, str(tmp_path / where), name, fmt, **options)
        assert rows_of(back) == [(1, "007")] and back.schema == schema(name)


def test_json_rows_keep_nulls(frame):
    got = one(sinks.json_rows(frame("a INT, b STRING", [(1, None)]), "s"))
    assert got["section"] == "s" and json.loads(got["result"]) == {"a": 1, "b": None}
    assert sinks.json_report({"x": frame("a INT", [(1,)]), "y": frame("b INT", [(2,), (3,)])}).count() == 3


def test_only_the_written_partitions_are_replaced(frame, spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "d INT, v INT"
    sinks.overwrite_partitions(frame(ddl, [(1, 1), (2, 2)]), path, "d")
    sinks.overwrite_partitions(frame(ddl, [(2, 9)]), path, "d")
    assert rows_of(spark.read.parquet(path), "d", "v") == [(1, 1), (2, 9)]


def test_shared_folder_follows_the_setting(spark, shared_root):
    assert sinks.shared_folder(spark, "x") != sinks.shared_folder(spark, "x")
    assert sinks.shared_folder(spark, "x").startswith(f"{shared_root}/x-")


def test_values_outside_a_closed_set(frame):
    assert rows_of(check_values(frame("s STRING", [("a",), ("z",), (None,)]), "s", ("a",))) == [("z",)]




def test_uploaded_files_route_by_name_and_decode_leniently(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF", "b.JPG": b"\xff\xd8", "c.txt": "né".encode() + b"\xff!", "d": b"plain"}.items():
        (tmp_path / name).write_bytes(data)
    got = rows_of(cases.route_documents(read_uploads(spark, str(tmp_path))), "filename", "route", "format", "block")
    assert got == [("a.pdf", "pdf", "pdf", None), ("b.JPG", "image", "jpeg", None), ("c.txt", "text", None, "né�!"), ("d", "text", None, "plain")]
