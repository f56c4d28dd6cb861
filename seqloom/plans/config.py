"""What a run does with its reads, as plan-time parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.demux import Demux
from ..operators.kernels import Adapter, Search

NO_LIMIT = 2**31 - 1


@dataclass(frozen=True)
class Config:
    """Defaults change nothing but split reads into kept and undetermined.

    most_n: share of Ns that a read may have, above 1 any; no_n: none at all.
    errors: expected errors instead of a mean quality. trim_n: above 1 off.
    window: of the quality trim; running: its running-sum form. must_*: reads
    that weren't trimmed, had no adapter or weren't merged are undetermined.
    strict: bases outside ACGTN are an error, else undetermined.
    """

    demux: Demux | None = None
    by_index: bool = False
    most_n: float = 2.0
    no_n: bool = False
    quality: float = 0.0
    errors: float | None = None
    trim_barcode: bool = False
    trim_enzyme: bool = False
    trim_n: float = 2.0
    quality_five: int = 0
    quality_three: int = 0
    window: int | None = 1
    running: bool = False
    adapters: tuple[Adapter, ...] = ()
    r_adapters: tuple[Adapter, ...] = ()
    adapter_search: Search = field(default_factory=lambda: Search(overlap=3))
    adapter_offset: int = 0
    merge: bool = False
    merge_search: Search = field(default_factory=lambda: Search(overlap=3))
    least_length: int = 0
    most_length: int = NO_LIMIT
    must_trim: bool = False
    must_adapter: bool = False
    must_merge: bool = False
    dedup: str | None = None  # "first" or "best"
    umi: int = 12
    strict: bool = False
