import hashlib

from ocuspark.llm import chat
from ocuspark.llm.queries import op2_chat_formatting

from .conftest import SMALL, rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    turns = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    tricky = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", tricky), (1, "assistant", tricky)]
    got = rows(op2_chat_formatting(spark, SMALL), "conv_id")
    assert got.keys() == turns.keys()
    for c, own in turns.items():
        own.sort()
        trained = "".join(t for _, role, t in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained))


def test_round_trip_of_any_text(spark):
    texts = ["", "\\", "\\\\h", "###", "####", "#####", "</turn>", "</tu</turn>rn>", "\\h###\\b", " ", "a\n### assistant: b </turn>\n", "é 😀 #", "##", "</turn", None, "x" * 100_000 + "###"]
    roles = ["user", "assistant", "a: b", "###", ": ", ":", "", None, "</turn>", "x:"]
    data = [(1, i, roles[i % len(roles)], t, "k") for i, t in enumerate(texts)] + [(2, None, "user", "first", "k"), (2, 3, "assistant", "b", "k"), (2, 3, "assistant", "a", "k"), (2, 3, "assistant", "a", "k"), (None, 0, "assistant", "n", "k")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, seq string").drop("seq")
    out = rows(chat.read_back(chat.render(chat.fold(chat.turn_events(df)))), "conv_id")
    assert [(t.role, t.text) for t in out[1].turns] == [(roles[i % len(roles)] or "", t or "") for i, t in enumerate(texts)]
    assert out[1].loss_text == "".join(t or "" for i, t in enumerate(texts) if roles[i % len(roles)] == "assistant")
    assert [t.text for t in out[2].turns] == ["first", "a", "a", "b"]
    assert [t.text for t in out[None].turns] == ["n"]
    assert chat.digests(chat.read_back(chat.render(chat.fold(chat.turn_events(df.limit(0)))))).collect() == []


def test_events_are_folded(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "He"), (1, 3, 1, "delta", "assistant", "llo"),
        (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", "assistant", "Good "), (1, 6, 1, "delta", None, "day"),
        (1, 7, 0, "edit", "user", "hey"), (1, 8, 2, "message", "user", "bye"), (1, 9, 2, "delete", None, None), (1, 10, 3, None, "user", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, op string, role string, text string").repartition(3)
    got = sorted((r.message, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(0, "user", "hey"), (1, "assistant", "Good day"), (3, "user", "")]


def test_streams_fold_into_the_turns(spark):
    """Of any text and any size of piece; the log has each kind of event, in another order than its own."""
    texts = ["", "x", "ab", "### a </turn>\\h", "é👩‍👩‍👧 " * 40, None, "line\n" * 50, " "]
    roles = ["assistant", "user", "assistant", None, "tool", "assistant"]
    data = [(c, i, roles[(i + c) % 6] if c is not None else "assistant", t, "k") for c in (1, 2, 3, None) for i, t in enumerate(texts)] + [(2, None, "assistant", "same", "k")] * 2
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, op string").drop("op")
    want = sorted(map(str, chat.fold(chat.turn_events(df)).collect()))
    for piece in (1, 3, 64):
        log = chat.streamed_events(df, piece=piece)
        assert sorted(map(str, chat.fold(log.repartition(3)).collect())) == want
    events = log.collect()
    assert {e.op for e in events} == {"message", "delta", "edit", "regenerate"} and len(events) > 2 * len(data)
    own = [e.seq for e in events if e.conv_id == 1]
    assert own != sorted(own) and len(set(own)) == len(own)
    assert chat.streamed_events(df.limit(0)).collect() == []
