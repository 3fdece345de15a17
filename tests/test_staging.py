"""The driver's garbage between two jobs."""

from types import SimpleNamespace

import pytest

from skein.sources import staging


@pytest.mark.parametrize(("now", "collects"), [(400, True), (300, False)])
def test_a_heap_beyond_half_is_collected(now, collects):
    ran = []
    heap = SimpleNamespace(totalMemory=lambda: now, maxMemory=lambda: 750, gc=lambda: ran.append(1))
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap))
    spark = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang))))
    assert staging.relieve(spark) is collects and ran == [1] * collects


def test_every_staged_table_looks_at_the_heap(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(staging, "relieve", asked.append)
    assert staging.staged(spark.range(3), "some").count() == 3 and asked == [spark]
