"""The corpus pipeline (part of the subpackage ``llm``, where its stages are): toxicity, exact dedup, SimHash near-dedup, mixing, BPE."""

from airsignal.llm.pipeline import STAGES, run  # noqa: F401

#: Learned models and hash draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
