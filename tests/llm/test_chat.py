"""Folding, rendering and reading back."""

import hashlib

from tessera.llm import chat

LOG = "conv_id long, seq long, message long, kind string, role string, text string, n_turns string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LOG)


def turns(spark, log):
    return {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(chat.fold(log))).collect()}


def test_fold(spark):
    log = events(spark, [
        (1, 5, 1, "delta", "assistant", "lo"), (1, 3, 1, "delta", "assistant", "Hel"), (1, 1, 0, "delta", "user", "hi"), (1, 6, 0, "edit", "user", "hi!"), (1, 7, 0, "delta", "user", "?"),
        (1, 8, 1, "regenerate", "assistant", None), (1, 9, 1, "delta", "assistant", "Bye"), (1, 10, 2, None, None, None), (2, 1, 0, "delta", "user", ""), (None, 1, 0, "delta", "user", "x"),
    ])
    assert turns(spark, log) == {1: [("user", "hi!?"), ("assistant", "Bye"), ("", "")], 2: [("user", "")], None: [("user", "x")]}


def test_escapes_restore_and_masks_cover(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<s>\n[INST]", "[/INST]</s>\n", "a\\[INST]b", "<", "</s", "[/INST", "é\n\n", "𝒳[INST]", "x" * 100_000]
    rows = [(1, i, i, "delta", "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, 0, "delta", "</s>[INST]\n", "role")]
    log = events(spark, rows)
    got = turns(spark, log)
    assert got[1] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    assert got[2] == [("</s>[INST]\n", "role")]
    rendered = {r.conv_id: r for r in chat.render(chat.fold(log)).collect()}
    assert rendered[1].formatted.count("</s>") == len(nasty)
    row = {r.conv_id: r for r in chat.digests(chat.parse(chat.render(chat.fold(log)))).collect()}[1]
    loss = "".join(t for i, t in enumerate(nasty) if i % 2)
    assert (row.n_turns, row.loss_chars) == (len(nasty), len(loss))
    assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in got[1]).encode()).hexdigest()
    assert row.formatted_chars == len(rendered[1].formatted)


def test_log_of_finished_turns_folds_to_them(spark):
    said = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c}, with some words") for c in range(8) for t in range(8)]
    log = chat.events_of(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["edit"] > 5 and kinds["regenerate"] > 5 and kinds["delta"] > len(said)
    assert turns(spark, log) == {c: [(r, x) for d, _, r, x in said if d == c] for c in range(8)}


def test_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as text")
    log = rows.selectExpr("conv_id", "turn as seq", "turn as message", "'delta' as kind", "role", "text")
    row = chat.digests(chat.parse(chat.render(chat.fold(log)))).first()
    loss = "".join(f"text {i}" for i in range(1, n, 2))
    assert (row.n_turns, row.loss_sha256) == (n, hashlib.sha256(loss.encode()).hexdigest())


def test_repeated_rows_and_none(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert turns(spark, chat.events_of(rows)) == {1: [("user", "a"), ("user", "a"), ("", "")]}
    assert chat.digests(chat.parse(chat.render(chat.fold(chat.events_of(rows.where("false")))))).count() == 0
