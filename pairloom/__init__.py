"""Deterministic, weighted, byte-level byte-pair tokenization on Spark. Names are loaded when first used."""

from __future__ import annotations

from importlib import import_module

_EXPORTS = {
    "errors": ("ArtifactError", "CodecError", "EngineError", "ManifestError", "RunError", "SourceError", "TokenError"),
    "functions.sql": ("register",),
    "functions.tokens": ("ALIASES", "BASE", "CANONICAL", "MAX_VOCAB", "N_SPECIAL", "SPECIAL", "SpecialTokens", "allocate", "byte_token", "check_id", "check_target", "pair_key", "pair_key_column"),
    "operators.codec": ("Coder", "EncodedDocument", "Limits", "bound_documents", "decode_join", "decoder", "encode_distinct", "encode_native", "encoder", "evidence", "unbound_documents"),
    "operators.packing": ("calibrate", "offsets", "pack", "read_corpus", "repeated", "write_corpus"),
    "operators.presegment": ("lines", "lossless", "segments", "special_spans", "statistics"),
    "operators.stats": ("family_weight", "opportunity", "pair_counts", "symbol_words", "top_pairs", "word_counts"),
    "operators.tokenizer": ("Tokenizer", "merge_faults"),
    "operators.train": ("Merge", "TrainConfig", "TrainingStats", "train", "train_with_stats"),
    "operators.written": ("clean",),
    "plans.runs": ("Source", "compare_runs", "run_pipeline", "source_authority", "validate_run"),
    "sources.artifacts": ("ArtifactSource", "Metadata", "build", "inspect", "read_pair", "read_pair_v2"),
    "sources.manifest": ("COMPOSITE", "FAMILIES", "SINGLE", "Admitted", "admit", "scan", "scan_directory"),
    "sources.publish": ("Context", "load_package", "measure", "read_manifest", "write_package"),
    "streaming.encode": ("count_stream", "encode_stream"),
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = globals()[name] = getattr(import_module(f".{_HOME[name]}", __name__), name)
    return value


def encode(df, tokenizer, text: str = "text", ids: str = "token_ids"):
    """``df`` with the token ids of a text or binary column."""
    from pyspark.sql import functions as F

    from .operators.codec import encoder

    return df.withColumn(ids, encoder(df.sparkSession, tokenizer)(F.col(text)))


def decode(df, tokenizer, ids: str = "token_ids", decoded: str = "decoded"):
    """``df`` with the bytes that a column of token ids stands for."""
    from .operators.codec import decoder

    return df.withColumn(decoded, decoder(df.sparkSession, tokenizer)(ids))
