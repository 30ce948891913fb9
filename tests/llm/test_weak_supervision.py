"""Spans that only the weak supervision finds, and candidates that it turns down."""

import pytest

from inkwell.llm import personal_data

PROVEN = [f"Contact u{i}@mail{i % 3}.example.org or call +1 555 010 {i:04d} please. server 10.1.{i}.7 is up." for i in range(40)]
ADDED = {
    1000: ("Contact jane.doe [at] mail1.example.org today", "email:8:39"),
    1001: ("write to bob at mail2 dot example dot org now", "email:9:41"),
    1002: ("the server 10.1.x.x answers", "ip:11:19"),
    1003: ("server 10[.]1[.]5[.]9 is blocked", "ip:7:21"),
    1004: ("my card 4111 **** **** 1111 expired", "card:8:27"),
    1005: ("phone 555-010-7788 evenings", "phone:6:18"),
    1006: ("call five five five zero one zero seven seven eight eight", "phone:5:57"),
}
TURNED_DOWN = {2000: "order 12 34 56 78 99 arrived", 2001: "version 7.7.x.x is out", 2002: "ISBN 978-3-16-1484-1000", 2003: "id 1234/5678/9012/3456", 2004: "Seen at noon. The dot stays."}
CARDS = [f"my card 4111 1111 1111 1111 and card 5500 0000 0000 0004 ({i})" for i in range(12)]


@pytest.fixture(scope="module")
def found(spark):
    rows = [*enumerate(PROVEN + CARDS), *((i, t) for i, (t, _) in ADDED.items()), *TURNED_DOWN.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame, {r["doc_id"]: r for r in personal_data.find(frame).collect()}


def test_added_spans_are_accepted(found):
    for i, (text, span) in ADDED.items():
        row = found[1][i]
        assert row["spans"] == span, (text, row["spans"])
        assert sum(row[f"n_{k}"] for k in personal_data.KINDS) == 0  # base counts stay


def test_unlikely_candidates_are_turned_down(found):
    assert {i: found[1][i]["spans"] for i in TURNED_DOWN} == dict.fromkeys(TURNED_DOWN, "")


def test_base_spans_stay(found):
    for i in range(len(PROVEN)):
        assert len(found[1][i]["spans"].split(",")) == 3 and found[1][i]["n_email"] == found[1][i]["n_ip"] == found[1][i]["n_phone"] == 1


def test_added_spans_are_redacted(found):
    out = {r["doc_id"]: r["text"] for r in personal_data.redact(found[0]).where("doc_id >= 1000").collect()}
    assert out[1001] == "write to [EMAIL] now" and out[1004] == "my card [CARD] expired"
    assert all(out[i] == t for i, t in TURNED_DOWN.items())


def test_reliabilities_tell_good_labelers_from_noise():
    """Votes drawn from known reliabilities: EM finds the share and ranks the labelers."""
    import random
    from collections import Counter

    rng = random.Random(5)
    table = Counter()
    for _ in range(20_000):
        true = rng.random() < 0.3
        vote = lambda p, q: 1 if rng.random() < (p if true else q) else -1  # noqa: B023, E731
        table[(vote(0.9, 0.1), 1 if rng.random() < (0.6 if true else 0.05) else 0, rng.choice([1, 0, -1]), 1 if rng.random() < (0.5 if true else 0.01) else 0)] += 1
    share, chance = personal_data.reliabilities(sorted(table.items()))
    assert share == pytest.approx(0.3, abs=0.03)
    assert chance[0][1][0] == pytest.approx(0.9, abs=0.04) and chance[0][1][1] == pytest.approx(0.1, abs=0.04)
    assert abs(chance[2][1][0] - chance[2][1][1]) < 0.05


def test_gazetteer_is_whole_beyond_the_keys_that_tasks_hold(spark, monkeypatch):
    """With room for one key in all tasks the others are joined, and the results are the same."""
    hosts = [f"host{h}" for h in "abcd"]
    rows = [f"reach {i}bob@{h}.zone now" for i in "defghijklmnopqr" for h in hosts]
    rows += [f"reach bob at {h} dot zone now" for h in hosts] + [f"look at thing{i} dot stop now" for i in "abcdefghijklmnopqrst"] + ["nothing", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "_more long, text string").selectExpr("_more as doc_id", "text", "_more")
    whole, redacted = ({r["doc_id"]: r for r in f(frame).collect()} for f in (personal_data.find, personal_data.redact))
    assert [whole[i]["spans"] for i in (60, 63, 64, 84, 85)] == ["email:6:27", "email:6:27", "", "", ""]
    monkeypatch.setattr(personal_data, "GAZETTEER", 1)
    assert {r["doc_id"]: r for r in personal_data.find(frame).collect()} == whole
    again = personal_data.redact(frame)
    assert again.columns == frame.columns and {r["doc_id"]: r for r in again.collect()} == redacted


def test_written_out_addresses_of_any_length(spark):
    """Neither long names nor many parts are cut off a candidate."""
    name, parts = "n" * 90, " dot ".join(["mail", "x" * 40, "a", "b", "c", "example", "org"])
    told = personal_data.candidates(personal_data.F.col("text"))
    for text in (f"{name} at {parts}", f"{name} [at] {parts}"):
        got = spark.createDataFrame([(f"to {text}, now",)], "text string").select(told.alias("s")).first()["s"]
        assert [(s["kind"], s["start"], s["end"]) for s in got] == [(0, 3, 3 + len(text))]
