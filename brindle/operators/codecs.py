"""Vectors to compact codes: sign bits of projections, or levels of a scalar quantizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import projection


def _rows(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


class SignCodec:
    """k stacks of dim sign bits of the centred, truncated vector; compared by Hamming distance.

    A bit is 1 if the projection is above zero, strictly; bits run from the most significant on."""

    name = "sign"

    def __init__(self, dim: int, k: int, seed: int = 0, kind: str = "srht", rounds: int = 3, mean=None, planes: np.ndarray | None = None, int8: bool = False):
        if dim % 8 or dim <= 0 or k <= 0:
            raise ValueError("dim must be a positive multiple of 8 and k positive")
        self.dim, self.k, self.seed, self.kind, self.rounds, self.mean, self.int8 = dim, k, seed, kind, rounds, mean, int8
        self.planes = projection.planes(kind, dim, k, seed, rounds) if planes is None else planes
        if int8 and planes is None:
            self.planes = projection.from_int8(*projection.to_int8(self.planes))

    @property
    def bits(self) -> int:
        return self.dim * self.k

    @property
    def row_bytes(self) -> int:
        return self.bits // 8

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed bytes of rows of full-width vectors."""
        x = np.asarray(x, np.float64)
        if self.mean is not None:
            x = x - np.asarray(self.mean, np.float64)
        x = x[:, : self.dim]
        p = np.concatenate([x @ q.astype(np.float64) for q in self.planes], axis=1)
        return np.packbits(p > 0, axis=1)

    def words(self, x: np.ndarray) -> np.ndarray:
        """Codes as signed 64-bit words, padded with zero bits."""
        c = self.encode(x)
        pad = -c.shape[1] % 8
        return np.ascontiguousarray(np.pad(c, ((0, 0), (0, pad)))).view(">i8").astype(np.int64)

    def column(self, vec: Column) -> Column:
        """The words of a vector column; null for null."""
        codec = self

        @F.arrow_udf("array<bigint>")
        def code(col: pa.Array) -> pa.Array:
            ok = col.drop_null()
            w = codec.words(_rows(ok)) if len(ok) else np.zeros((0, 1), np.int64)
            n = np.where(col.is_valid().to_numpy(zero_copy_only=False), w.shape[1], 0) if len(col) else np.zeros(0, int)
            offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            mask = col.is_null()
            return pa.ListArray.from_arrays(pa.array(offs), pa.array(w.ravel()), mask=mask if col.null_count else None)

        return code(vec)


    def packed(self, vec: Column) -> Column:
        """The packed bytes of a vector column, as files hold them; null for null."""
        codec = self

        @F.arrow_udf("binary")
        def code(col: pa.Array) -> pa.Array:
            ok = col.drop_null()
            raw = iter(codec.encode(_rows(ok))) if len(ok) else iter(())
            return pa.array([next(raw).tobytes() if v else None for v in col.is_valid().to_pylist()], pa.binary())

        return code(vec)


class LevelCodec:
    """Rotation, then each coordinate as one of 2**bits Lloyd-Max levels; compared by inner product.

    Vectors must have length one; there is no centring. Codes are self-consistent: the rotation comes from
    this library's seed or from the index."""

    name = "levels"

    def __init__(self, dim: int, bits: int = 4, seed: int = 0, rotation: np.ndarray | None = None):
        if not 1 <= bits <= 8 or dim * bits % 8 or dim <= 0:
            raise ValueError("bits must be 1 to 8 and dim * bits a multiple of 8")
        self.dim, self.width, self.seed = dim, bits, seed
        self.rotation = projection.haar(dim, 1, seed)[0] if rotation is None else rotation
        self.centroids, self.cuts = projection.levels(bits)

    @property
    def row_bytes(self) -> int:
        return self.dim * self.width // 8

    def index(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)[:, : self.dim]
        n = np.linalg.norm(x, axis=1, keepdims=True)
        z = (x / np.where(n == 0, 1, n)) @ self.rotation.astype(np.float64) * np.sqrt(self.dim)
        return np.searchsorted(self.cuts, z, side="left").astype(np.uint8)

    def decode(self, index: np.ndarray) -> np.ndarray:
        """Vectors of length one that the codes stand for."""
        y = self.centroids[index] @ self.rotation.astype(np.float64).T
        n = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.where(n == 0, 1, n)

    def encode(self, x: np.ndarray) -> np.ndarray:
        i = self.index(x)
        return np.frombuffer(projection.pack_bits(i, self.width), np.uint8).reshape(len(i), -1)

    def unpack(self, raw: bytes) -> np.ndarray:
        n = len(raw) // self.row_bytes
        return projection.unpack_bits(raw, self.width, n * self.dim).reshape(n, self.dim)

    def column(self, vec: Column) -> Column:
        codec = self

        @F.arrow_udf("binary")
        def code(col: pa.Array) -> pa.Array:
            ok = col.drop_null()
            raw = iter(codec.encode(_rows(ok))) if len(ok) else iter(())
            return pa.array([next(raw).tobytes() if v else None for v in col.is_valid().to_pylist()], pa.binary())

        return code(vec)

    def decoded(self, code: Column) -> Column:
        """The vectors that a code column stands for; null for null."""
        codec = self

        @F.arrow_udf("array<double>")
        def vec(col: pa.Array) -> pa.Array:
            ok = col.drop_null().to_pylist()
            x = codec.decode(np.concatenate([codec.unpack(v) for v in ok])) if ok else np.zeros((0, codec.dim))
            n = np.where(col.is_valid().to_numpy(zero_copy_only=False), codec.dim, 0) if len(col) else np.zeros(0, int)
            offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offs), pa.array(x.ravel()), mask=col.is_null() if col.null_count else None)

        return vec(code)

    def similarity(self, code: Column, q: np.ndarray) -> Column:
        """Cosine of each decoded code with a query vector."""
        codec = self
        u = np.asarray(q, np.float64)[: self.dim]
        u = u / (np.linalg.norm(u) or 1.0)

        @F.arrow_udf("double")
        def cos(col: pa.Array) -> pa.Array:
            raw = col.fill_null(b"\0" * codec.row_bytes)
            x = codec.decode(np.concatenate([codec.unpack(v) for v in raw.to_pylist()] or [np.zeros((0, codec.dim), np.uint8)]))
            return pa.array(x @ u)

        return cos(code)
