"""What the operators give back to the system."""

from __future__ import annotations

import gc
import time
from pathlib import Path

import pytest

from talweg.llm.bpe import Codec
from talweg.llm.common import collect_garbage, release


def test_the_driver_gives_native_memory_back(spark):
    """Buffers of 64 kB are taken by malloc; a few that stay keep it from giving back the others when they are freed."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    if not status.exists():
        pytest.skip("memory can't be read here")
    in_use = lambda: int(status.read_text().split("VmRSS:")[1].split()[0]) // 1024
    collect_garbage(spark)  # loads what it needs
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(2000)]
    buffers = buffers[::50]
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
        time.sleep(1)
    before = in_use()
    collect_garbage(spark)
    assert in_use() < before - 60


def test_a_codec_goes_with_the_next_operators_task():
    """A codec is some 130 MB of a worker, which later stages and runs in the same session need."""
    from base64 import b64encode

    ranks = b"\n".join(b64encode(bytes([i])) + b" %d" % i for i in range(256))
    codec = Codec.of(ranks, r"\S+|\s+")
    release(Codec._made)  # as its own tasks end
    assert Codec.of(ranks, r"\S+|\s+") is codec
    release()  # as those of all others do
    assert Codec.of(ranks, r"\S+|\s+") is not codec
