import pytest

from specloom.llm import chat
from specloom.llm.common import cut
from specloom.llm.chat import REPLY, events_of, link_tool_calls

SCHEMA = "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, after array<string>, content string, key string, at int"
TOOLS = {
    "w": {
        "required": ["city"],
        "properties": {"city": {"type": "string", "minLength": 2}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "u": {"enum": ["c", "f"]}},
        "additionalProperties": False,
    }
}


def event(conv, turn, kind, call_id=None, arguments=None, after=(), content=None, name="w"):
    return conv, turn, "r", kind, call_id, name if kind == "call" else None, arguments, list(after), content, "k", 1


def linked(spark, *events):
    return link_tool_calls(spark.createDataFrame(list(events), SCHEMA), TOOLS).collect()


def test_links_orders_and_validates(spark):
    rows = linked(
        spark,
        event(1, 3, "call", "x", '{ "n": 9, "city":"Rome"}', ["y"]), event(1, 1, "result", "x", content="r"), event(1, 5, "call", "y", '{"city":"R","z":1,"u":"k"}'),
        event(1, 6, "result", "y", content='say "é"\n'), event(1, 7, "result", "y"), event(1, 8, "result", "q"), event(1, 9, "call", "p", "[1", ["zz"], name="v"), event(1, 0, "message", content="hi"),
    )
    by = {(r["kind"], r["call_id"], r["turn"]): r for r in rows}
    order = [r["turn"] for r in sorted(rows, key=lambda r: (r["ready_turn"], r["depth"], r["turn"]))]
    assert order == [0, 5, 6, 3, 1, 7, 8, 9]  # x waits for y's result, and x's result for x
    assert by["call", "x", 3]["errors"] == "n: maximum" and by["call", "x", 3]["json"] == '{"arguments":{"city":"Rome","n":9},"id":"x","kind":"call","name":"w","role":"r"}'
    assert by["call", "y", 5]["errors"] == "city: minLength,u: enum,z: not expected"
    assert '"arguments":"[1"' in by["call", "p", 9]["json"]
    assert by["call", "p", 9]["errors"] == "arguments: not JSON,v: no such tool,after: zz"
    assert by["result", "y", 6]["json"] == '{"content":"say \\"é\\"\\n","id":"y","kind":"result","role":"r"}'
    assert [by[k]["status"] for k in (("call", "x", 3), ("result", "y", 7), ("result", "q", 8), ("call", "p", 9), ("message", None, 0))] == ["linked", "duplicate", "no_call", "no_result", "message"]


def test_cycles_and_chains(spark):
    cycle = [event(2, 1, "call", "a", "{}", ["b"]), event(2, 2, "call", "b", "{}", ["a"]), event(2, 3, "result", "a"), event(2, 4, "result", "b")]
    chain = [e for k in range(6) for e in (event(3, 20 - k, "call", f"c{k}", '{"city":"Rome"}', [f"c{k - 1}"] if k else []), event(3, 30 - k, "result", f"c{k}"))]
    rows = linked(spark, *cycle, *chain)
    assert {r["status"] for r in rows if r["conv_id"] == 2} == {"cyclic"} and {r["status"] for r in rows if r["conv_id"] == 3} == {"linked"}
    place = {(r["kind"], r["call_id"]): (r["ready_turn"], r["depth"]) for r in rows if r["conv_id"] == 3}
    for k in range(6):
        assert place["call", f"c{k}"] < place["result", f"c{k}"] and (not k or place["result", f"c{k - 1}"] < place["call", f"c{k}"])


def test_odd_rows(spark):
    odd = [event(None, None, None), event(None, 1, "call", "a", None), event(None, 2, "result", "a"), event(4, None, "call", "b", "{}"), event(4, 2, "call", None, "3"), event(4, 2, "call", None, "3")]
    rows = linked(spark, *odd)
    assert len(rows) == 6 and [r["status"] for r in rows if r["conv_id"] is None and r["call_id"]] == ["linked", "linked"]
    assert all("arguments: not an object" in r["errors"] for r in rows if r["kind"] == "call" and r["call_id"] is None)
    assert linked(spark, *[event(1, 1, "call", "a", "{}")] * 3)[2]["status"] in ("no_result", "duplicate")
    assert link_tool_calls(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0


def test_a_cycle_in_a_long_conversation(spark, monkeypatch):
    """10,000 calls in a chain, two of which wait for each other: few rounds, and all others stay at their turns."""
    rounds = []
    monkeypatch.setattr(chat, "cut", lambda df, name: rounds.append(name) or cut(df, name))
    calls = [event(1, 2 * k, "call", f"c{k}", '{"city":"Rome"}', [f"c{k - 1}"] if k else []) for k in range(10_000)]
    calls[5_000] = event(1, 10_000, "call", "c5000", '{"city":"Rome"}', ["c4999", "c5001"])
    rows = linked(spark, *calls, *[event(1, 2 * k + 1, "result", f"c{k}") for k in range(10_000)])
    assert {r["call_id"] for r in rows if r["status"] == "cyclic"} == {"c5000", "c5001"} and rounds.count("ready") < 10
    assert len(rows) == 20_000 and all(r["ready_turn"] == r["turn"] and r["depth"] == 0 for r in rows)


def test_against_brute_force(spark):
    """Random waits, hot identifiers and cycles, on the plan for few rows and for many: places by relaxation, cycles by reachability."""
    import random

    for seed in range(3):
        r, events, waits, turns = random.Random(seed), [], {}, {}
        ids = [f"c{k}" for k in range(24)]
        turn = list(range(48))
        r.shuffle(turn)
        for k, i in enumerate(ids):
            waits[i] = sorted({ids[0] if r.random() < 0.3 else r.choice(ids) for _ in range(r.choice([0, 0, 1, 1, 2]))} - {i})
            turns[i] = sorted((turn[2 * k], turn[2 * k + 1]))
            events += [event(7, turns[i][0], "call", i, "{}", waits[i]), event(7, turns[i][1], "result", i)]
        reach = {i: set(waits[i]) for i in ids}
        for _ in ids:
            for i in ids:
                reach[i] |= {z for y in reach[i] for z in reach[y]}
        cyclic = {i for i in ids if i in reach[i]}
        between = {i for i in ids if reach[i] & cyclic and any(i in reach[c] for c in cyclic)}
        call, result = {i: (t[0], 0) for i, t in turns.items()}, {i: (t[1], 0) for i, t in turns.items()}
        rows = linked(spark, *events)
        told = {x["call_id"] for x in rows if x["status"] == "cyclic"}
        assert told <= between  # of a cycle whose calls are in order as they stand nothing is out of order
        for _ in range(200):
            for i in ids:
                if i not in told:
                    call[i] = max([call[i], *((result[w][0], result[w][1] + 1) for w in waits[i])])
                    result[i] = max(result[i], (call[i][0], call[i][1] + 1)) if call[i] > (turns[i][0], 0) else result[i]
        assert {i for i in ids if i in reach[i] and i not in told} == set()
        for x in rows:
            assert (x["ready_turn"], x["depth"]) == (call if x["kind"] == "call" else result)[x["call_id"]]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(chat, "BROADCAST_CALLS", 0)
            patch.setattr("specloom.llm.common.HOT_SHARES", 5)
            patch.setattr("specloom.llm.common.LEAST_HOT", 1)
            assert sorted(map(repr, linked(spark, *events))) == sorted(map(repr, rows))


def test_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = link_tool_calls(events_of(table), REPLY).collect()
    source = {(r["conv_id"], r["turn"]): r for r in table.collect()}
    role = lambda c, t: source[c, t]["role"] if (c, t) in source else None
    assert len(rows) == table.count() and any(r["depth"] for r in rows) and any(r["errors"] for r in rows)
    for r in rows:
        conv, turn = r["conv_id"], r["turn"]
        if r["kind"] == "message":
            continue
        call = turn if r["kind"] == "call" else turn - 1
        links = 0
        while role(conv, call + 2 * links) == "user" and "\n" in source[conv, call + 2 * links]["text"] and role(conv, call + 2 * links + 3) == "assistant":
            links += 1
        if role(conv, call) != "user":
            links = 0
        assert r["depth"] == (0 if not links else 2 * links - (r["kind"] == "call"))
        assert r["ready_turn"] == (call + 2 * links + 1 if links else turn)
        if r["kind"] == "call":
            assert r["status"] == ("linked" if role(conv, turn + 1) == "assistant" else "no_result")
            text = source[conv, turn]["text"]
            lost = "\n" in text and role(conv, turn + 3) != "assistant"
            assert r["errors"] == ",".join(filter(None, ["content: maxLength" * (len(text) > 400), "turn: maximum" * (turn > 5), f"after: {turn + 2}" * lost]))


def test_very_long_texts(spark):
    long = "x" * 300_000
    rows = {r["call_id"]: r for r in linked(spark, event(1, 1, "call", "a", '{"city":"' + long + '"}'), event(1, 2, "call", "b", long), event(1, 3, "result", "a", content=long))}
    assert len(rows["a"]["json"]) > 300_000 and rows["b"]["errors"] == "arguments: not JSON,city: required" and long in rows["b"]["json"]
