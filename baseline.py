
from __future__ import annotations

import json
import os
import statistics
import time

import numpy as np
import pyarrow.parquet as pq


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

    def vectors() -> tuple[np.ndarray, np.ndarray]:
        t = pq.read_table(f"{sf}/embeddings.parquet", columns=["vec_id", "embedding"])
        v = np.stack(t.column("embedding").to_pylist()).astype(np.float32).astype(np.float64)
        return t.column("vec_id").to_numpy() // 5, v / np.sqrt((v * v).sum(1))[:, None]

    def top(scores: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-np.round(scores, 6), axis=1, kind="stable")[:, :k]

    def h1_nearest() -> None:
        _, v = vectors()
        top(v[:1] @ v.T, 50)

    def h3_e8_g1_nearest_many() -> None:
        _, v = vectors()
        top(v @ v.T, 10)

    def h6_connections_all() -> None:
        note, v = vectors()
        own, at = np.unique(note, return_inverse=True)
        mean = np.zeros((len(own), v.shape[1]))
        np.add.at(mean, at, v)
        s = mean @ v.T
        s[at[None, :] == np.arange(len(own))[:, None]] = -np.inf
        for row in top(s, 15):
            list(dict.fromkeys(note[row].tolist()))[:5]

    def c5_paragraph_blocks() -> None:
        for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist():
            [p for p in (t or "").replace("\n", "\n\n").split("\n\n") if len(p) >= 100]

    took = {}
    for f in (c5_paragraph_blocks, h1_nearest, h3_e8_g1_nearest_many, h6_connections_all):
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            f()
            runs.append(time.perf_counter() - began)
        took[f.__name__] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "single-machine brute force, medians", "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
