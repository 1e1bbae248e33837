"""Content-addressed byte analytics on Spark: the main operators by name."""

from importlib import import_module

_WHERE = {
    "pack": "operators.archives", "unpack": "operators.archives", "train": "operators.codebook", "PackOptions": "operators.packing", "route": "operators.packing",
    "decode": "operators.packing", "nearest_codeword": "operators.search", "local_session": "session",
}
__all__ = list(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:  # imported when asked for, so that workers load only what they use
        return getattr(import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)
