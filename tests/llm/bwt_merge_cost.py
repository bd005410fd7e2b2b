"""Cost of telling 200-byte strings apart by merging shards' Burrows-Wheeler transforms: python tests/llm/bwt_merge_cost.py MB...

Interleave refinement over all shards of a block at once: the current interleave is dealt by the symbol before each
suffix, in order (a counting sort), which makes suffixes that are sorted by k bytes sorted by k + 1. Suffixes whose common
prefix with both neighbours is shorter are settled and left out from then on. After 200 rounds, the intervals that are left
are the repeated strings. Equal texts are taken once. Not a test: it prints CPU seconds.
"""

import sys
import time
from collections import Counter

import numpy as np
import pyarrow.dataset as ds


def refine(text: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, int]:
    """Positions whose `rounds`-byte string occurs elsewhere, and the positions handled in all rounds. 0 ends a text."""
    at = np.argsort(text, kind="stable")
    kind = text[at].astype(np.int64)
    handled = 0
    for _ in range(rounds - 1):
        keep = (at > 0) & (kind != 0) if _ == 0 else at > 0
        at, kind = at[keep] - 1, kind[keep]
        symbol = text[at]
        inside = symbol != 0
        at, kind, symbol = at[inside], kind[inside], symbol[inside]
        handled += len(at)
        order = np.argsort(symbol, kind="stable")
        at, kind, symbol = at[order], kind[order], symbol[order]
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (symbol[1:] != symbol[:-1])]) if len(at) else np.zeros(0, bool)
        alone = new & np.concatenate([new[1:], [True]]) if len(at) else new
        kind = np.cumsum(new)[~alone]
        at = at[~alone]
    return at, handled


def main(sizes: list[float]) -> None:
    texts = dict.fromkeys(t.encode() for t in ds.dataset("/root/testdata/check_s/documents.parquet").to_table(columns=["text"]).column("text").to_pylist() if t)
    small = b"\0" + b"\0".join([b"a" * 250, b"xy" * 120, b"q" + b"xy" * 110, b"z" * 199]) + b"\0"
    count = Counter(small[i : i + 200] for i in range(len(small) - 199))
    want = {i for i in range(len(small) - 199) if 0 not in small[i : i + 200] and count[small[i : i + 200]] > 1}
    assert set(refine(np.frombuffer(small, np.uint8))[0].tolist()) == want
    for mb in sizes:
        block, n = [], 0
        for t in texts:
            if n + len(t) > mb * 1e6:
                break
            block.append(t)
            n += len(t) + 1
        data = np.frombuffer(b"\0" + b"\0".join(block) + b"\0", np.uint8)
        began = time.process_time()
        left, handled = refine(data)
        used = time.process_time() - began
        print(f"{len(data) / 1e6:.1f} MB: {len(left) / len(data):.3f} repeated, {handled / len(data):.1f} positions handled a byte, {used:.1f} CPU s, {used / len(data) * 1e9:.0f} a GB", flush=True)


if __name__ == "__main__":
    main([float(x) for x in sys.argv[1:]] or [1, 4])
