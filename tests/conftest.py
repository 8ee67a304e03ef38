import pathlib
import struct
import sys
import zlib

import pytest
from pyspark import cloudpickle

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import builders  # noqa: E402

from faultline.session import local_session  # noqa: E402

# Fake scorers travel to the workers with their code, as a user's notebook functions do.
cloudpickle.register_pickle_by_value(builders)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", memory="6g")
    yield session
    session.stop()


@pytest.fixture
def png():
    """Bytes of a valid one-colour PNG of the given size."""

    def make(width: int, height: int, shade: int = 120) -> bytes:
        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
        pixels = zlib.compress((b"\x00" + bytes([shade]) * width) * height)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")

    return make
