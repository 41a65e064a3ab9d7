import json

import pytest

from fixtures_llm import documents, frame
from mezze.llm import chat, warc


def formatted(records):
    return chat.format_turns(chat.canonical_turns(records))


def test_layouts_give_one_conversation(spark):
    want = [("user", "Why?\n<turn x>"), ("assistant", "\\l </turn>\n ok \\")]
    layouts = [
        ("prompt", {"prompt": want[0][1], "response": want[1][1]}),
        ("instruction", {"instruction": want[0][1], "output": want[1][1], "input": ""}),
        ("messages", {"messages": [{"role": r, "content": t} for r, t in want], "meta": {"a": [1, {"b": 2}]}}),
        ("from_value", {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in want]}),
    ]
    records = spark.createDataFrame([(i, json.dumps(x)) for i, (_, x) in enumerate(layouts)], "conv_id long, record string")
    assert [r["layout"] for r in chat.canonical_turns(records).orderBy("conv_id").collect()] == [n for n, _ in layouts]
    for r in chat.read_formatted(formatted(records)).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss_texts"] == [want[1][1]]


def test_unknown_and_broken_records(spark):
    rows = [(1, None), (2, "{"), (3, '{"a": 1}'), (None, '{"prompt": null, "response": "x"}'), (4, "[]"), (5, '{"messages": []}'), (6, "3")]
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    nothing = (None, [])
    assert got == {1: nothing, 2: nothing, 3: nothing, 4: nothing, 6: nothing, 5: ("messages", []), None: ("prompt", [("user", ""), ("assistant", "x")])}


def test_records_of_any_shape(spark):
    deep = "[" * 200_000 + "]" * 200_000
    nested = '{"a":' * 900 + "1" + "}" * 900
    parts = [{"type": "text", "text": "x"}, {"type": "image", "id": 1}, "y"]
    records = [
        ('{"messages[]": 1}', None, []), ('{"messages[].role": 1, "messages[].content": 2}', None, []), ('{"a": {"prompt": 1}, "response": ""}', None, []),
        (r'{"prompt": "\ud800x", "response": "\ud83d\ude00", "k\udc00": 1}', "prompt", [("user", "\ufffdx"), ("assistant", "\U0001f600")]),
        (deep, None, []), (nested, None, []), ('{"messages": 3}', None, []), ('{"messages": null}', None, []), ('{"messages": [1, null, {"role": "user", "content": "u"}]}', "messages", [("user", "u")]),
        (json.dumps({"messages": [{"role": "user", "content": parts}]}), "message_parts", [("user", 'x\n{"type": "image", "id": 1}\ny')]),
        (json.dumps({"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "z"}]}), "messages", [("user", 'x\n{"type": "image", "id": 1}\ny'), ("assistant", "z")]),
    ]
    rows = spark.createDataFrame([(i, r, "x", 1) for i, (r, _, _) in enumerate(records)], "conv_id long, record string, layout string, turns int")
    got = chat.canonical_turns(rows).orderBy("conv_id").collect()
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in got] == [(n, t) for _, n, t in records]
    assert got[4]["fingerprint"] is None and got[5]["fingerprint"]
    assert sum(r["n"] for r in chat.shapes(chat.canonical_turns(rows)).collect()) == len(records)


def test_callers_layouts(spark):
    record = {"q": "Q", "a": "A", "prompt": "p", "response": "r"}
    rows = spark.createDataFrame([(1, json.dumps(record)), (2, '{"q": "x", "a": "y"}')], "conv_id long, record string")
    layouts = {**chat.LAYOUTS, "faq": {"must": {"q", "a"}, "may": set(), "turns": [("user", "q"), ("assistant", "a")]}}
    names = lambda **how: [r["layout"] for r in chat.canonical_turns(rows, layouts, **how).orderBy("conv_id").collect()]
    assert names() == ["prompt", "faq"]
    assert names(chosen={chat.fingerprint(record): "faq"}) == ["faq", "faq"]


def test_roles_are_held_one_by_one(spark):
    rows = spark.createDataFrame([(1, 0, "user,assistant", "x"), (2, 0, "system,user", "s"), (2, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    back = chat.read_formatted(formatted(chat.records_of(rows))).orderBy("conv_id").collect()
    assert [[tuple(t) for t in r["turns"]] for r in back] == [[("user,assistant", "x")], [("system,user", "s"), ("assistant", "a")]]


def test_fingerprint_ignores_values_and_order():
    a = chat.fingerprint({"x": [{"p": 1}, {"q": 2}], "y": 3})
    assert a == chat.fingerprint({"y": 4, "x": [{"q": 5, "p": 6}, {"p": 1}]})
    assert a != chat.fingerprint({"x": [{"p": 1}], "y": 3})


def test_conversation_rows_come_back(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (1, 0, "user", None), (2, 0, "tool<>\n", ""), (3, None, None, "x"), (3, 5, "assistant", "<\\>\\\\l"), (None, 0, "user", "a"), (5, 0, "human", "q"), (5, 1, "assistant", "é\U0001f600"), (7, 0, "system", "s"), (7, 1, "user", "u"), (7, 2, "assistant", "a"), (9, 2, "user", "z"), (9, 1, "user", "y"), (11, 0, "user", "long " * 200_000)]
    back = chat.read_formatted(formatted(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    for r in back:
        assert r["loss_texts"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]


def test_no_conversations(spark):
    assert chat.read_formatted(formatted(chat.records_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


PAGES = [
    (5, "http://a/\r\nX: 1", "same", 1), (3, None, "same", 1), (9, "http://b", "same", 1), (3, "u", "same", 1), (1, "u", None, 1), (2, "u", "", 1), (4, "u", "WARC/1.1\r\n\r\n\r\nWARC-Type: response\r\n\r\né", 1),
    (None, "u", "alone", 1), (None, "u", "same", 1), (10, "u", "x" * 3_000_000, 1),
]


def test_archives_resolve_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload_digest int")
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_round_trip(pages).collect()), key=str)
    want = [(5, "revisit", 3, 4), (3, "response", None, 4), (9, "revisit", 3, 4), (3, "response", None, 4), (1, "response", None, 0), (2, "revisit", 1, 0), (4, "response", None, len(PAGES[6][2].encode())), (None, "response", None, 5), (None, "revisit", 3, 4), (10, "response", None, 3_000_000)]
    assert rows == sorted(want, key=str)


def test_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, n int")
    warc.write_archives(pages, f"{tmp_path}/w", least=5)
    read = warc.read_archives(spark, f"{tmp_path}/w")
    assert {r["record_type"] for r in read.collect()} == {"response"}
    assert sorted(r["html"] for r in read.collect()) == sorted(p[2] or "" for p in PAGES)


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages_take_effect(spark):
    import corpus_pipeline
    from mezze.llm import mixing, near, quality

    docs = frame(spark)
    counts = [len(documents())]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "").cache()
        counts.append(docs.count())
        if name != "encoding":
            assert docs.columns == before.columns
    assert counts[0] > counts[1] >= counts[2] > counts[3]
    kept = {r["doc_id"] for r in quality.judge(frame(spark)).filter("kept").collect()}
    encoded = {r["doc_id"] for r in docs.collect()}
    assert encoded <= kept
    assert all(r["n_tokens"] == len(r["ids"]) for r in docs.collect())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_chat", "op5_divergence", "op7_warc_revisits", "op8_minhash", "op9_licenses"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    from mezze.llm import registry

    rows = registry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    columns = sorted(rows.columns)
    sql = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})")
    assert sorted(map(str, (tuple(r) for r in rows.select(columns).collect()))) == sorted(map(str, sql.fetchall()))
