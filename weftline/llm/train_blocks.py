"""python -m weftline.llm.train_blocks: train the block labeller anew and write its weights."""

import numpy as np

from . import html_blocks as H
from .page_maker import make_page

if __name__ == "__main__":
    model = H.train_model()
    H.WEIGHTS.parent.mkdir(exist_ok=True)
    np.savez_compressed(H.WEIGHTS, **{k: v.astype(np.float16) for k, v in model.p.items()})
    model = H.BiLSTM.load()
    right = total = pages = 0
    for seed in range(300):
        got = H.labelled(*make_page(seed))
        if got:
            p = model.label([H.vectors([b for b, _ in got])])[0] >= 0.5
            ok = p == np.array([y for _, y in got], bool)
            right, total, pages = right + ok.sum(), total + len(ok), pages + ok.all()
    print(f"blocks right {right / total:.4f}, pages right {pages / 300:.3f}")
