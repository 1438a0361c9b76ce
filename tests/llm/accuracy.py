"""python tests/llm/accuracy.py [DIR]: the quality classifier fitted on half of a table's labels, on the other half."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import numpy as np
import pyarrow.parquet as pq

from tessel.llm import quality


def held_out(folder):
    labels = {r["doc_id"]: (r["quality"] == 1 and r["toxic"] == 0, r["toxic"]) for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in labels)
    fitted, held = rows[::2][: quality.TRAINING], rows[1::2]
    model = quality.train([t for _, t in fitted], [labels[i][0] for i, _ in fitted])
    score = np.zeros(len(held))
    d = quality.Encoder().encode([t for _, t in held])
    score[d.bags > 0] = quality.probabilities(model, d)[0]
    good = np.array([labels[i][0] for i, _ in held])
    toxic = np.array([labels[i][1] == 1 for i, _ in held])
    kept = score >= model.threshold
    return {"fitted": len(fitted), "threshold": round(model.threshold, 4), "good kept": round(float(kept[good].mean()), 4), "bad rejected": round(float((~kept[~good]).mean()), 4), "toxic rejected": round(float((~kept[toxic]).mean()), 4)}


if __name__ == "__main__":
    began = time.time()
    print(held_out(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"), round(time.time() - began), "s")
