"""What a worker process keeps between tasks."""

import gc
import weakref

from faultline.llm.support import worker_value


class Cache:
    """Something large."""


def test_a_worker_drops_what_earlier_jobs_left():
    first, other = (weakref.ref(worker_value((kind, 1), Cache)) for kind in ("units of a test", "words of a test"))
    assert worker_value(("units of a test", 1), Cache) is first()

    def build():
        gc.collect()
        assert first() is None  # gone before the next is made, so the two never add up
        return Cache()

    second = worker_value(("units of a test", 2), build)
    assert worker_value(("units of a test", 2), Cache) is second
    assert other() is not None


def test_some_kinds_keep_the_last_few():
    held = [worker_value(("models of a test", n), Cache, 2) for n in (1, 2)]
    assert worker_value(("models of a test", 1), Cache, 2) is held[0]
    worker_value(("models of a test", 3), Cache, 2)
    assert worker_value(("models of a test", 1), Cache, 2) is held[0]
    assert worker_value(("models of a test", 2), Cache, 2) is not held[1]
