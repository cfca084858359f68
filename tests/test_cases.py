from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

from tallyline.operators import cases
from tests.conftest import at, one, rows_of


def flat(make, *rows):
    base = dict(sender_name="s", receiver_name="r", amount=1.0, gsi_list="list", gsi_match_score=0.1, transfers_30d=1)
    return cases.case_records(make("cases_flat", [base | r for r in rows]))


def test_the_two_sample_cases(make):
    t = flat(
        make,
        dict(mtcn="high", gsi_match_score=0.83, flags="Amounts consistently just under the reporting threshold,Receiver added 9 days ago"),
        dict(mtcn="low", gsi_match_score=0.51, flags="Consistent monthly remittance pattern,Long-standing sender/receiver relationship"),
    )
    got = {r.mtcn: (r.grade, r.recommendation, r.confidence) for r in cases.grade_cases(t).collect()}
    assert got == {"high": ("HIGH", "ESCALATE", 0.6), "low": ("LOW", "APPROVE", 0.6)}
    risks = rows_of(cases.risk_indicators(t), "mtcn", "position", "severity", "evidence")
    assert risks == [
        ("high", 1, "high", "list (score 0.83)"),
        ("high", 2, "high", "Amounts consistently just under the reporting threshold"),
        ("low", 1, "medium", "list (score 0.51)"),
    ]


def test_grading_thresholds(make):
    grid = [
        ("a", 0.75, None, "HIGH"), ("b", 0.7499, None, "MEDIUM"), ("c", 0.5, None, "MEDIUM"), ("d", 0.49, None, "LOW"),
        ("e", 0.7, "legitimate", "MEDIUM"), ("f", 0.69, "LEGITIMATE", "LOW"), ("g", 0.1, "Possible STRUCTURing", "HIGH"),
        ("h", 0.6, "consistent, threshold", "HIGH"), ("i", 0.0, " , ,", "LOW"),
    ]
    t = flat(make, *[dict(mtcn=m, gsi_match_score=s, flags=f) for m, s, f, _ in grid])
    got = {r.mtcn: r.grade for r in cases.grade_cases(t).collect()}
    assert got == {m: g for m, _, _, g in grid}


def test_comma_lists_are_trimmed_and_empties_dropped(make):
    r = one(flat(make, dict(mtcn="1", gsi_matched_fields=" name, partial DOB ,,", flags=None)))
    assert r["gsi_hit"].matched_fields == ["name", "partial DOB"] and r["flags"] == []


def test_regrade_and_final_grade(frame):
    t = frame("mtcn STRING, grade STRING, prior_grade STRING", [("1", "LOW", "HIGH"), ("2", "LOW", "odd"), ("3", "HIGH", None)])
    docs = cases.regrade_with_document(t)
    assert rows_of(docs, "mtcn", "document_grade") == [("1", "HIGH"), ("2", "MEDIUM"), ("3", "MEDIUM")]
    data = frame("mtcn STRING, grade STRING", [("1", "LOW"), ("9", "HIGH")])
    assert rows_of(cases.final_grade(data, docs)) == [("1", "HIGH"), ("9", "HIGH")]


DOCS = "filename STRING, content_type STRING, text STRING"


def test_routes(frame):
    t = frame(
        DOCS,
        [
            ("a.PDF", None, ""), ("b", "application/pdf", ""), ("c.JPG", None, ""), ("d.webp", "text/plain", ""),
            ("e", "image/tiff", ""), ("f", "IMAGE/GIF", ""), ("g.txt", "text/plain", "hi"), ("my_file (1)[x].v2.txt", None, "x"), (".hidden", None, "y"),
        ],
    )
    got = {r.filename: (r.route, r.format, r.safe_name) for r in cases.route_documents(t).collect()}
    assert got == {
        "a.PDF": ("pdf", "pdf", "a"), "b": ("pdf", "pdf", "b"), "c.JPG": ("image", "jpeg", "c"), "d.webp": ("image", "webp", "d"),
        "e": ("image", "png", "e"), "f": ("image", "gif", "f"), "g.txt": ("text", None, "g"),
        "my_file (1)[x].v2.txt": ("text", None, "my-file (1)[x]-v2"), ".hidden": ("text", None, "document"),
    }


def test_blocks_hold_the_whole_text(frame):
    text = "".join(random.Random(1).choices("abcé\U0001f600 \n", k=45_001))
    t = frame(DOCS, [("t.txt", None, text), ("n.txt", None, None)])
    got = cases.route_documents(t).filter("filename = 't.txt'").orderBy("block_no").collect()
    assert [len(r.block) for r in got] == [20_000, 20_000, 5_001] and "".join(r.block for r in got) == text


def test_model_answers_are_parsed_or_quarantined(frame):
    body = '{"grade": "LOW", "recommendation": "APPROVE", "confidence": 0.9, "rationale": "r", "risk_indicators": [{"indicator": "i", "severity": "low", "evidence": "{e}"}]}'
    rows = [
        ("plain", body), ("fenced", f"```json\n{body}\n```"), ("bare fence", f"``` {body} ```"), ("chatty", f"Sure! {body} Bye."),
        ("none", "no answer"), ("empty", "  "), ("backwards", "} {"), ("cut", body[:-1]), ("grade", body.replace("LOW", "AVERAGE")),
        ("rec", body.replace("APPROVE", "SHRUG")), ("sev", body.replace('"severity": "low"', '"severity": "dire"')), ("missing", '{"grade": "LOW"}'),
    ]
    out = cases.parse_model_outputs(frame("id STRING, text STRING", rows))
    assert rows_of(out["good"], "id") == [("bare fence",), ("chatty",), ("fenced",), ("plain",)]
    assert {r.risk_indicators[0].evidence for r in out["good"].collect()} == {"{e}"}
    assert dict(rows_of(out["quarantine"], "id", "reason")) == {
        "none": "no JSON object", "empty": "empty answer", "backwards": "no JSON object", "cut": "schema", "grade": "grade",
        "rec": "recommendation", "sev": "severity", "missing": "schema",
    }


def test_latest_accepted_decision_wins(frame):
    ddl = "mtcn STRING, action STRING, grade STRING, decided_at TIMESTAMP, decision_id INT"
    t = frame(ddl, [("1", "DENIED", "HIGH", at(2026, 6, 1), 1), ("1", "APPROVED", "LOW", at(2026, 6, 2), 2), ("1", "MAYBE", "LOW", at(2026, 6, 3), 3), ("2", "approved", "LOW", at(2026, 6, 3), 4)])
    assert rows_of(cases.latest_decisions(t), "mtcn", "action") == [("1", "APPROVED")]


def test_rolling_structuring_with_a_sender_holding_a_third_of_all_transfers(frame):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        sender = 1 if i % 3 == 0 else rnd.randint(2, 20)
        rows.append((sender, i, date(2026, 1, 1) + timedelta(days=rnd.randint(0, 120)), Decimal(rnd.randint(8000, 11000))))
    t = frame("sender_id INT, txn_id INT, sent_on DATE, amount DECIMAL(18,2)", rows)
    got = {r.txn_id: (r.transfers_30d, int(r.total_30d), r.just_under_limit) for r in cases.threshold_structuring(t, 10000, 1000).collect()}
    for s, i, d, _ in rows:
        near = [a for s2, _, d2, a in rows if s2 == s and 0 <= (d - d2).days <= 30]
        assert got[i] == (len(near), sum(near), sum(9000 <= a < 10000 for a in near))


def test_every_missing_field_goes_to_quarantine(frame):
    import json

    answers = {
        "data": (cases.DATA_ANSWER, {
            "grade": "LOW", "recommendation": "APPROVE", "confidence": 0.5, "rationale": "r",
            "risk_indicators": [{"indicator": "i", "severity": "low", "evidence": "e"}],
        }),
        "document": (cases.DOCUMENT_ANSWER, {
            "detected_language": "de", "document_summary": "s", "document_findings": [{"finding": "f", "severity": "high", "evidence": "e"}], "grade": "LOW",
            "recommendation": "APPROVE", "confidence": 0.5, "grade_changed": False, "change_reason": "", "rationale": "r",
        }),
    }
    for answer, whole in answers.values():
        rows = [("whole", json.dumps(whole)), ("talk", "Sure: " + json.dumps(whole) + " done")]
        listed = answer[1]
        rows.append(("no entries", json.dumps(whole | {listed: []})))
        for field in whole:
            rows.append((field, json.dumps({k: v for k, v in whole.items() if k != field})))
        for part in whole[listed][0]:
            entry = {k: v for k, v in whole[listed][0].items() if k != part}
            rows.append((f"entry {part}", json.dumps(whole | {listed: [whole[listed][0], entry]})))
        out = cases.parse_model_outputs(frame("id STRING, text STRING", rows), answer=answer)
        assert rows_of(out["good"], "id") == [("no entries",), ("talk",), ("whole",)]
        assert {r.reason for r in out["quarantine"].collect()} == {"schema"}
        assert out["quarantine"].count() == len(rows) - 3
