"""One spelling for the names that the tables write in several ways; the core has it too."""

from quillon.functions.names import SPLIT_NAMES, bare_name, file_name, plain_key, plain_split, scene_name, stem_name

__all__ = ["SPLIT_NAMES", "bare_name", "file_name", "plain_key", "plain_split", "scene_name", "stem_name"]
