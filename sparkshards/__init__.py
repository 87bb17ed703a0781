"""Sharded sample archives on Spark.  Public names are loaded on first use, so that
executors which need one module do not load all."""

from __future__ import annotations

import importlib

_WHERE = {
    "plans.dataset": ["ShardDataset"],
    "sources.shardlists": ["MixSource", "MixSpec", "mix_from_yaml", "mix_from_yaml_file", "shardspec"],
    "sources.shards": ["TarShardSource", "group_members", "read_content", "read_shards", "register", "shard_frame", "write_shards"],
    "sources.opener": ["Opener", "gopen", "register_scheme", "schemes"],
    "sources.tario": ["Selection", "ShardWriter", "TarWriter", "read_samples"],
    "functions.names": ["base_plus_ext", "brace_expand", "expand_urls", "format_shard_pattern", "make_seed", "worker_info"],
    "functions.errors": ["OnError", "ShardError", "settle"],
    "functions.tensors": ["TENSOR", "read_npy", "read_npz", "read_tenbin", "write_npy", "write_npz", "write_tenbin"],
    "streaming.watch": ["for_each_batch", "watch"],
}
_HOME = {name: module for module, held in _WHERE.items() for name in held}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)
