"""The whole data preparation as one lazy graph; only k-core rounds and vocabularies materialise."""

from __future__ import annotations

import argparse
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cleanse, core, edges, masks, quality, split
from tidemark.settings import Settings
from tidemark.sources import readers


class Pipeline:
    """Raw log -> clean -> k-core -> split -> events, metadata, edges, masks, truth."""

    def __init__(self, raw: DataFrame, settings: Settings | None = None):
        self.raw, self.s = raw, settings or Settings()
        raw.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")

    @classmethod
    def sales(cls, spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> Pipeline:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return cls(readers.sales_log(spark, sf_dir), settings)

    @cached_property
    def clean(self) -> DataFrame:
        return cleanse.clean(self.raw, self.s)

    @cached_property
    def log(self) -> DataFrame:
        return core.k_core(self.clean, self.s)

    @cached_property
    def split(self) -> split.Split:
        """The vocabularies are numbered once and kept; all else is lazy."""
        return split.split(self.log, self.s, tuple(readers.cut_lineage(v) for v in split.vocabularies(self.log, self.s)))

    @cached_property
    def events(self) -> DataFrame:
        return edges.train_events(self.log, self.split, self.s)

    @cached_property
    def meta(self) -> DataFrame:
        return edges.item_metadata(self.log, self.split, self.s)

    @cached_property
    def users(self) -> DataFrame:
        return split.eval_users(self.split)

    def mask(self, *behaviors: str) -> DataFrame:
        return masks.train_mask(self.events, self.users, behaviors or (self.s.target,))

    @cached_property
    def behavior_edges(self) -> DataFrame:
        return self.events.select(F.col("behavior").alias("rel"), F.col("user_idx").alias("src"), F.col("item_idx").alias("dst"), F.col("timestamp").alias("ts"))

    def write(self, folder: str) -> None:
        """Every table, by name; edges by relation."""
        s = self.split
        tables = {
            "train_events": self.events, "user_vocab": s.users, "item_vocab": s.items, "train": s.train, "positives": s.positives, "truth": split.ground_truth(s), "candidates": s.candidates,
            "item_metadata": self.meta, "mask_primary": masks.mask_arrays(self.mask(), self.users), "mask_seen": masks.mask_arrays(self.mask(*self.s.behaviors), self.users), "edges": edges.typed_edges(self.events, self.meta),
        }
        readers.write_tables(tables, folder, {"edges": ["rel"]})
        readers.write_json(edges.node_counts(s, self.meta), f"{folder}/node_counts")
        readers.write_json(split.statistics(s), f"{folder}/split_stats")
        for kind in ("category", "brand"):
            readers.write_json(self.meta.select(kind, f"{kind}_idx").distinct(), f"{folder}/{kind}_vocab")

    def materialised(self) -> Pipeline:
        """The same with its positives, events and metadata materialised, for results that read them several times."""
        s = self.split
        self.__dict__["split"] = replace(s, train=readers.cut_lineage(s.train), positives=readers.cut_lineage(s.positives))
        for name in ("events", "meta"):
            self.__dict__.pop(name, None)
            self.__dict__[name] = readers.cut_lineage(getattr(self, name))
        self.__dict__.pop("behavior_edges", None)
        self.__dict__.pop("users", None)
        return self

    def verify(self) -> DataFrame:
        """Q12"""
        p = self.materialised()
        return quality.report(p.split, p.events, p.meta, p.s)


def main(args: list[str] | None = None) -> None:
    """Python -m tidemark.plans.pipeline --input 'logs/*.csv' --output folder [--settings file] [--train-end day ...]"""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--settings")
    for name, kind in (("train-end", str), ("val-end", str), ("min-user", int), ("min-item", int), ("rounds", int), ("target", str), ("category-level", str), ("metadata-source", str)):
        parser.add_argument(f"--{name}", type=kind)
    given = vars(parser.parse_args(args))
    source, output, file = given.pop("input"), given.pop("output"), given.pop("settings")
    base = Settings.load(file) if file else Settings()
    settings = Settings(**{f: given.get(f) if given.get(f) is not None else getattr(base, f) for f in base.__dataclass_fields__})
    spark = SparkSession.builder.getOrCreate()
    pipe = Pipeline(readers.read_raw_csv(spark, source), settings)
    pipe.write(output)
    bad = pipe.verify().where("violations > 0").collect()
    if bad:
        raise SystemExit(f"failed checks: {[(r.check, r.violations) for r in bad]}")


if __name__ == "__main__":
    main()
