"""The journal stream: appends, unfinished lines, truncation, malformed lines, chunks."""

import random

import pytest

from loomquery.sources import journal


def _runner(spark, tmp_path, **options):
    """Runs the stream over what is there, on one checkpoint; gives the new rows."""
    seen = []

    def run():
        def keep(batch, _):
            seen.extend((r["file"], r["at"], r["raw"], r["ok"]) for r in batch.select("file", "at", "raw", "ok").collect())

        seen.clear()
        stream = journal.tail_journal(spark, str(tmp_path / "log"), **options).writeStream.trigger(availableNow=True)
        stream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep).start().awaitTermination()
        return sorted(seen)

    return run


def test_appended_lines_arrive_once(spark, tmp_path):
    log = tmp_path / "log" / "a.jsonl"
    log.parent.mkdir()
    run = _runner(spark, tmp_path)
    assert run() == []
    log.write_bytes(b'{"n":1}\n{"n":2')
    assert run() == [("a.jsonl", 0, '{"n":1}', True)]
    assert run() == []
    with log.open("ab") as f:
        f.write(b'2}\r\n\n  \n[3]\n{bad\nnull\n"s"\n')
    (tmp_path / "log" / "sub").mkdir()
    (tmp_path / "log" / "sub" / "b.jsonl").write_text('{"é":1}\n')
    (tmp_path / "log" / "_tmp").write_text('{"hidden":1}\n')
    assert run() == [("a.jsonl", 8, '{"n":22}', True), ("a.jsonl", 22, "[3]", False), ("a.jsonl", 26, "{bad", False), ("a.jsonl", 31, "null", False), ("a.jsonl", 36, '"s"', False), ("sub/b.jsonl", 0, '{"é":1}', True)]
    assert run() == []


@pytest.mark.parametrize("new", [b'{"n":9}\n', b'{"n":9}\n{"n":10}\n{"n":11}\n{"n":12}\n', b""])
def test_replaced_files_restart(spark, tmp_path, new):
    """Shorter, or longer with another beginning: read from 0; lines added to it follow."""
    log = tmp_path / "log" / "a.jsonl"
    log.parent.mkdir()
    run = _runner(spark, tmp_path)
    log.write_bytes(b'{"n":1}\n{"n":2}\n')
    assert len(run()) == 2
    log.write_bytes(new)
    assert [r[2] for r in run()] == new.decode().split()
    with log.open("ab") as f:
        f.write(b'{"n":13}\n')
    assert [r[2] for r in run()] == ['{"n":13}']
    log.unlink()
    assert run() == []


def test_chunks_hold_each_line_once(spark, tmp_path):
    """Ranges of a few bytes each, lines of none to many of them, and random appends."""
    rng = random.Random(3)
    (tmp_path / "log").mkdir()
    run, text, got = _runner(spark, tmp_path, chunk="7"), "", []
    for _ in range(3):
        more = "".join("é" * rng.choice([0, 1, 2, 5, 30]) + rng.choice(["\n", "\n\n", "x\n", "y"]) for _ in range(12))
        with (tmp_path / "log" / "a").open("a") as f:
            f.write(more)
        text += more
        got += run()
        whole = text[: text.rfind("\n") + 1]
        assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [x for x in whole.split("\n") if x]


def test_lines_longer_than_a_block(tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "BLOCK", 4)
    for text in (b"", b"abcdefghij", b"\n", b"abc\nabcdefghij", b"abcdefghij\n", b"a\nb\n"):
        (tmp_path / "f").write_bytes(text)
        with (tmp_path / "f").open("rb") as f:
            assert journal._last_line_end(f, len(text)) == text.rfind(b"\n") + 1


def test_harvest(spark):
    lines = ['{"instruction":"Do it","steps":["a"]}', '{"instruction":"do","steps":[{"cmd":"x"},3]}', '{"instruction":" ","steps":["a"]}', '{"instruction":"x","steps":[]}', '{"instruction":"x","steps":[{"cwd":"y"}," "]}', '{"instruction":5,"steps":["a"]}', '{"steps":["a"]}', "[]", "{bad", '{"instruction":"x","steps":"a"}']
    rows = journal.parsed(spark.createDataFrame([("f", x) for x in lines], "file string, raw string"))
    assert [tuple(r) for r in journal.harvest(rows).collect()] == [("f", 10, 8, 2)]
