"""What a detection may be told."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

from byteloom.tables import registry
from byteloom.tables.registry import Era

MAX_BYTES, CHUNK_SIZE = 200_000, 65_536
#: Results at or below it are left out of a full list, unless none is above.
MINIMUM_THRESHOLD = 0.20


@dataclass(frozen=True)
class DetectOptions:
    """Checked when made, so a wrong name fails before any job starts."""

    encoding_era: int = Era.ALL
    include_encodings: tuple[str, ...] | None = None
    exclude_encodings: tuple[str, ...] | None = None
    max_bytes: int = MAX_BYTES
    no_match_encoding: str = "cp1252"
    empty_input_encoding: str = "utf-8"
    prefer_superset: bool = False
    compat_names: bool = True
    should_rename_legacy: bool = False
    chunk_size: int = CHUNK_SIZE
    lang_filter: int | None = None
    language: bool = True

    def __post_init__(self):
        if not isinstance(self.max_bytes, int) or isinstance(self.max_bytes, bool) or self.max_bytes < 1:
            raise ValueError("max_bytes must be a positive integer")
        if self.chunk_size != CHUNK_SIZE:
            warnings.warn("chunk_size is not used and will be ignored", DeprecationWarning, stacklevel=3)
        if self.lang_filter is not None:
            warnings.warn("lang_filter is not implemented and will be ignored", DeprecationWarning, stacklevel=3)
        if self.should_rename_legacy:
            warnings.warn("should_rename_legacy is deprecated, use prefer_superset instead", DeprecationWarning, stacklevel=3)
            object.__setattr__(self, "prefer_superset", True)
        for name in ("include_encodings", "exclude_encodings"):
            wanted = getattr(self, name)
            if wanted is not None:
                object.__setattr__(self, name, tuple(sorted(registry.require_all(wanted, name))))
        for name in ("no_match_encoding", "empty_input_encoding"):
            object.__setattr__(self, name, registry.require(getattr(self, name), name))
        for name in ("no_match_encoding", "empty_input_encoding"):
            if getattr(self, name) not in self.allowed:
                warnings.warn(f"{name} {getattr(self, name)!r} is excluded by the filters; such rows get encoding NULL", UserWarning, stacklevel=3)

    @cached_property
    def candidates(self) -> tuple[registry.Encoding, ...]:
        include, exclude = (None if x is None else frozenset(x) for x in (self.include_encodings, self.exclude_encodings))
        return tuple(registry.candidates(self.encoding_era, include, exclude))

    @cached_property
    def allowed(self) -> frozenset[str]:
        return frozenset(e.name for e in self.candidates)
