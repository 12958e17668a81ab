"""Fits the models that need no table again and writes the files of their weights."""

from __future__ import annotations

import numpy as np

from passagemill.llm import markup, scans, transcripts


def main() -> None:
    transcripts.fitted().keep(transcripts.WEIGHTS)
    scans.fitted().keep(scans.WEIGHTS)
    np.savez_compressed(markup.WEIGHTS, **{k: v.astype(np.float16) for k, v in markup.trained().p.items()})


if __name__ == "__main__":
    main()
