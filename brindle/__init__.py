"""brindle: building, maintaining and querying searchable document indexes on Apache Spark."""

__version__ = "0.1.0"

_AT = {
    "Index": "plans.index", "IndexWriter": "plans.index", "SyncStats": "plans.index", "pack_directory": "plans.index", "search": "plans.index",
    "Archive": "sources.archive", "ArchiveIndex": "sources.archive", "detect": "sources.archive", "migrate": "sources.archive",
    "Embedder": "functions.embedding", "HashEmbedder": "functions.embedding", "TableEmbedder": "functions.embedding",
    "SignCodec": "operators.codecs", "LevelCodec": "operators.codecs", "session": "session",
}


def __getattr__(name: str):
    if name in _AT and name != "session":
        from importlib import import_module

        return getattr(import_module(f"brindle.{_AT[name]}"), name)
    raise AttributeError(name)
