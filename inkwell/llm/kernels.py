"""The inner steps of the attention model: fused graphs of the ONNX runtime where it is installed, else the same in numpy.

A graph is written out as a protocol buffer by a few lines here, made once for a process and run on one thread.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

try:
    import onnxruntime
except ImportError:  # the numpy forms below serve alone
    onnxruntime = None

#: name: inputs, outputs, and steps (operator, inputs, outputs, attributes) of a graph
GRAPHS = {
    "attend": (
        ("q", "k", "v", "bias", "mask", "w2", "x1"), ("share", "mixed", "hidden"),
        [("FusedMatMul", "q k", "s", {"transB": 1}), ("Add", "s bias", "t", {}), ("Add", "t mask", "u", {}), ("Softmax", "u", "share", {"axis": -1}), ("MatMul", "share v", "mixed", {}), ("MatMul", "mixed w2", "z", {}), ("Add", "z x1", "y", {}), ("Tanh", "y", "hidden", {})],
    ),
    "shares": (("hidden", "wo", "b", "rows"), ("p",), [("Gemm", "hidden wo b", "z", {}), ("Add", "z rows", "y", {}), ("Softmax", "y", "p", {"axis": -1})]),
    "log_shares": (("hidden", "wo", "b", "rows"), ("p",), [("Gemm", "hidden wo b", "z", {}), ("Add", "z rows", "y", {}), ("LogSoftmax", "y", "p", {"axis": -1})]),
    "attend_back": (
        ("q", "k", "v", "share", "d", "own"), ("ds", "dq", "pairs"),
        [("FusedMatMul", "d v", "s", {"transB": 1}), ("Sub", "s own", "t", {}), ("Mul", "t share", "ds", {}), ("MatMul", "ds k", "dq", {}), ("FusedMatMul", "ds q", "dk", {"transA": 1}), ("FusedMatMul", "share d", "dv", {"transA": 1}), ("Concat", "dk dv", "pairs", {"axis": 2})],
    ),
    "products": (
        ("p", "hidden", "mixed", "dz", "x", "dkv", "asked", "dq"), ("wo", "w2", "wkv", "wq", "w1"),
        [("Gemm", f"{a} {b}", c, {"transA": 1}) for a, b, c in (("hidden", "p", "wo"), ("mixed", "dz", "w2"), ("x", "dkv", "wkv"), ("asked", "dq", "wq"), ("asked", "dz", "w1"))],
    ),
}
RANK = {"attend": {"bias": 2, "w2": 2}, "attend_back": {}, "shares": {"b": 1}, "log_shares": {"b": 1}, "products": {}}  # of arrays


def _number(n: int) -> bytes:
    n, out = n & ((1 << 64) - 1), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(key: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(key << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(key << 3 | 2) + _number(len(value)) + value


def model_bytes(name: str) -> bytes:
    """A graph as an ONNX ModelProto, its arrays of float32 and of any sizes."""
    inputs, outputs, steps = GRAPHS[name]

    def array(key: int, x: str) -> bytes:
        rank = RANK[name].get(x, 3 if name.startswith("attend") else 2)
        sizes = b"".join(_field(1, _field(2, f"{x}{i}")) for i in range(rank))
        return _field(key, _field(1, x) + _field(2, _field(1, _field(1, 1) + _field(2, sizes))))

    graph = b""
    for kind, used, made, attributes in steps:
        node = b"".join(_field(1, x) for x in used.split()) + _field(2, made) + _field(4, kind)
        node += b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in attributes.items())
        graph += _field(1, node + (_field(7, "com.microsoft") if kind.startswith("Fused") else b""))
    graph += _field(2, name) + b"".join(array(11, x) for x in inputs) + b"".join(array(12, x) for x in outputs)
    return _field(1, 8) + _field(8, _field(1, "") + _field(2, 17)) + _field(8, _field(1, "com.microsoft") + _field(2, 1)) + _field(7, graph)


def _attend(q, k, v, bias, mask, w2, x1):
    share = q @ k.swapaxes(1, 2)
    share += bias
    share += mask
    share -= share.max(axis=2, keepdims=True)
    np.exp(share, out=share)
    share /= share.sum(axis=2, keepdims=True)
    mixed = share @ v
    return share, mixed, np.tanh(mixed @ w2 + x1)


def _log_shares(hidden, wo, b, rows):
    logits = hidden @ wo
    logits += b
    logits += rows
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return [logits]


def _attend_back(q, k, v, share, d, own):
    ds = d @ v.swapaxes(1, 2)
    ds -= own
    ds *= share
    return ds, ds @ k, np.concatenate([ds.swapaxes(1, 2) @ q, share.swapaxes(1, 2) @ d], axis=2)


def _products(p, hidden, mixed, dz, x, dkv, asked, dq):
    return hidden.T @ p, mixed.T @ dz, x.T @ dkv, asked.T @ dq, asked.T @ dz


PLAIN = {"products": _products, "attend": _attend, "shares": lambda *a: [np.exp(_log_shares(*a)[0])], "log_shares": _log_shares, "attend_back": _attend_back}


@functools.cache
def kernel(name: str) -> Callable[..., list[np.ndarray]]:
    """What takes a graph's inputs, contiguous float32 arrays, in their order and gives its outputs."""
    if onnxruntime is None:
        return PLAIN[name]
    told = onnxruntime.SessionOptions()
    told.intra_op_num_threads = told.inter_op_num_threads = 1
    told.log_severity_level = 3
    told.enable_mem_pattern = False  # sizes vary
    session, names = onnxruntime.InferenceSession(model_bytes(name), told, providers=["CPUExecutionProvider"]), GRAPHS[name][0]
    return lambda *arrays: session.run(None, dict(zip(names, arrays, strict=True)))
