"""Tables that cut lineage, in the folder that all executors share (the library's own)."""

from ..sources.scratch import dropped, exists, shared_dir, spent, stored, unused

__all__ = ["dropped", "exists", "shared_dir", "spent", "stored", "unused"]
