import pytest

from quillspark.storage import hadoop_path
from quillspark.streaming.ledger import Ledger, append_stream


def ids(ledger):
    return sorted(r["id"] for r in ledger.read().collect())


def test_broken_and_repeated_batches(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"{tmp_path}/log", "id long")
    assert ids(ledger) == []
    assert ledger.commit(spark.range(0, 3), 0)
    # broken off between writing and renaming: no batch, and it can be repeated
    with monkeypatch.context() as m:
        m.setattr(Ledger, "rename", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            ledger.commit(spark.range(3, 5), 1)
    assert ids(ledger) == [0, 1, 2]
    assert ledger.commit(spark.range(3, 5), 1) and not ledger.commit(spark.range(3, 5), 1)
    assert ids(ledger) == [0, 1, 2, 3, 4]
    # two writers of one batch: the later rename finds the number taken
    first, second = ledger.write_aside(spark.range(5, 7)), ledger.write_aside(spark.range(5, 7))
    assert ledger.rename(first, 2) and not ledger.rename(second, 2)
    assert ids(ledger) == list(range(7))
    ledger.clean()
    where, system = hadoop_path(spark, f"{tmp_path}/log/aside")
    assert not system.exists(where) and ids(ledger) == list(range(7))


def test_a_stream_that_breaks_off(spark, tmp_path, monkeypatch):
    spark.range(40).repartition(4).write.parquet(f"{tmp_path}/in")
    ledger = Ledger(spark, f"{tmp_path}/log", "id long")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rename, calls = Ledger.rename, []

    def failing(self, aside, batch):
        calls.append(batch)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return rename(self, aside, batch)

    with monkeypatch.context() as m:
        m.setattr(Ledger, "rename", failing)
        with pytest.raises(Exception, match="lost"):
            append_stream(stream(), ledger, f"{tmp_path}/state")
    assert 0 < len(ids(ledger)) < 40
    append_stream(stream(), ledger, f"{tmp_path}/state")
    assert ids(ledger) == list(range(40))
    append_stream(stream(), ledger, f"{tmp_path}/state")
    assert ids(ledger) == list(range(40))
