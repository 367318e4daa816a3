"""A quantified experiment as tables: one long fact table and three small dimensions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class SiteDataset:
    """measure(feature, sample, intensity, loc_prob, ...), features(feature, ...), samples(sample, condition, ...).

    A missing cell is an absent row or a null intensity. provenance: what was done, in order.
    """

    measure: DataFrame
    features: DataFrame
    samples: DataFrame
    provenance: list[tuple[str, str]] = field(default_factory=list)

    def replace(self, step: str = "", note: str = "", **tables: DataFrame) -> SiteDataset:
        own = {"measure": self.measure, "features": self.features, "samples": self.samples} | tables
        return SiteDataset(**own, provenance=[*self.provenance, (step, note)] if step else list(self.provenance))
