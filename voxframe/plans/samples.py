"""A whole sample run: route and render, anatomy and pose, resolution, artifacts, and the guard of the final geometry.

Cases are drawn and staged once; each branch runs on its own cases and what the
branches made is united and staged again, so nothing is rendered twice. All draws
are keyed by seed, case and name alone: with the same seed, two mixes differ only
in what their shares differ in, so a sample with artifacts pairs with the one
without.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.staging import stage
from ..operators import anatomy, stages
from ..operators.registry import by_shape, with_pandas
from .routing import DEFAULT, faithful

#: The protocols of standard anchors and their sequences, all at 3 T.
STANDARD = {"MPRAGE": "MPRAGE", "MP2RAGE": "MP2RAGE", "T2": "SPACE_T2", "FLAIR": "FLAIR"}
#: Routes that later stages may change; the others are anchors.
BROAD = ("benign", "label_synthesis")
FALLBACK = "clean_geometry_fallback"
#: Seeds of redraws lie so far apart that no stage's own offsets meet.
REDRAW = 1000


@dataclass(frozen=True)
class Mix:
    """Shares of the routes and chances of the stages."""

    shares: dict[str, float] = field(default_factory=lambda: dict(DEFAULT))
    acquisition: float = 0.55
    morphology: float = 0.7
    pose: float = 1.0
    resolution: float = 0.6
    artifacts: float = 0.30


#: The mixes of validation samples: the same draws, with and without artifacts.
CATEGORIES = {"benign": Mix(shares={"benign": 1.0}, artifacts=0.0), "nonbenign": Mix(shares={"benign": 1.0}, artifacts=1.0), "synthetic": Mix(shares={"label_synthesis": 1.0}, artifacts=0.0)}


def planned(case: Column, seed: int, mix: Mix) -> dict[str, Column]:
    """route, protocol and the stages that a case takes, by keyed draws; anchors take none."""
    u = lambda *d: draws.uniform(seed, case, "sample", *d)
    route = draws.choice(u("route"), mix.shares)
    broad = route.isin(*BROAD)
    return {
        "route": route, "protocol": F.when(route == "standard", draws.choice(u("protocol"), {k: 1.0 for k in STANDARD})),
        "morphed": (route == "benign") & (u("morphology") < mix.morphology), "posed": broad & (u("pose") < mix.pose),
        "coarse": broad & (u("resolution") < mix.resolution), "artifact": broad & (u("artifact") < mix.artifacts),
    }


def _apart(rows: DataFrame, chosen: Column | str, change) -> DataFrame:
    """The rows with change() on those that are chosen; rows are staged, so both parts read what was made once."""
    chosen = F.col(chosen) if isinstance(chosen, str) else chosen
    return rows.filter(~chosen).unionByName(change(rows.filter(chosen)).select(*rows.columns))


def _guarded(rows: DataFrame) -> DataFrame:
    """Pairs whose mask geometry_accepted() refuses are the source pair again, of the kind FALLBACK."""

    def judge(pdf):
        accepted = np.zeros(len(pdf), bool)
        for rows, before, after in by_shape(pdf["_target"], pdf["mask"], pdf["shape"]):
            accepted[rows] = anatomy.geometries_accepted(before > 0, after)
        return pdf.assign(accepted=accepted)

    done = with_pandas(rows, judge, "accepted boolean", changed=())
    keep = lambda now, was: F.when(F.col("accepted"), F.col(now)).otherwise(F.col(was))
    return done.withColumns({"voxels": keep("voxels", "_image"), "mask": keep("mask", "_target"), "kind": F.when(F.col("accepted"), F.col("kind")).otherwise(FALLBACK)}).drop("accepted")


def draw(cases: DataFrame, seed: int, mix: Mix | None = None) -> DataFrame:
    """Each case (case_id, voxels, mask, shape) as one training sample; adds route and kind.

    The order is route and rendering, anatomy, pose, resolution, artifacts, and
    the guard, under which a refused geometry gives the source pair back. `kind`
    names the rendering and, after plus signs, the artifacts. Where the stage of
    resolution ran, the artifact `anisotropy`, a second coarsening, is left out. A case with a
    null id, scan, mask or shape stays as it is, of the kind null. An operator's
    error fails the query. Rows that share an id get the same draws; other columns stay.
    """
    mix = mix or Mix()
    own = {"_image": F.transform("voxels", lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))), "_target": F.transform("mask", lambda m: m.cast("boolean"))}
    rows = cases.withColumns(own | planned(F.col("case_id").cast("string"), seed, mix)).withColumns({"voxels": F.col("_image"), "mask": F.col("_target"), "kind": F.lit(None).cast("string")})
    rows = stage(rows.withColumn("whole", F.col("case_id").isNotNull() & F.col("voxels").isNotNull() & F.col("mask").isNotNull() & F.col("shape").isNotNull()), "planned")
    whole = rows.filter("whole")

    def acquired(part: DataFrame) -> DataFrame:
        """Another machine's scan, or where none was drawn another look."""
        made = stage(stages.realistic_acquisition(part, seed, mix.acquisition), "acquired")
        return _apart(made, F.col("acquisition").isNull(), lambda r: stages.appearance(r, seed)).drop("acquisition")

    sequence = F.create_map(*[F.lit(x) for p in STANDARD.items() for x in p])[F.col("protocol")]
    branches = {
        "clean": lambda r: r.withColumn("kind", F.lit("clean")),
        "standard": lambda r: stages.render_sequence(r, sequence, seed=seed).withColumn("kind", F.col("protocol")),
        "benign": lambda r: acquired(r).withColumn("kind", F.lit("benign")),
        "label_synthesis": lambda r: anatomy.moved(r, "label_synthesis", seed).withColumn("kind", F.lit("synthetic")),
    }
    parts = [branches[name](whole.filter(F.col("route") == name)).select(*rows.columns) for name in mix.shares]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)

    for name, change in (("morphed", lambda r: anatomy.moved(r, "morph", seed)), ("posed", lambda r: anatomy.moved(r, "pose", seed)), ("coarse", lambda r: stages.resolution(r, seed))):
        made = _apart(stage(made, name), name, change)

    made = _apart(stage(made, "rendered"), "artifact", lambda r: _overlaid(r, seed))
    done = _guarded(made).unionByName(rows.filter("NOT whole").select(*made.columns))
    return done.select(*cases.columns, "route", "kind")


def _overlaid(rows: DataFrame, seed: int) -> DataFrame:
    coarsened = F.when(F.col("coarse"), F.array(F.lit("anisotropy"))).otherwise(F.array().cast("array<string>"))
    return stages.overlay(rows, seed, without=coarsened).withColumn("kind", F.concat_ws("+", "kind", "artifacts"))


def draw_category(cases: DataFrame, seed: int, category: str, max_draws: int = 3, mix: Mix | None = None) -> DataFrame:
    """draw() with the mix of a category, drawn again where the kind isn't faithful to it, `max_draws` times in all; the last draw stays.

    Adds attempts and faithful, so that samples that aren't what was asked for can be counted. Only the cases that are left are drawn again.
    """
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    if max_draws < 1:
        raise ValueError("a sample needs a draw")
    mix, left, out = mix or CATEGORIES[category], cases, None
    for attempt in range(max_draws):
        again = left.columns
        sources = stage(left.withColumn("_n", F.monotonically_increasing_id()), "sources")
        made = stage(draw(sources, seed + attempt * REDRAW, mix).withColumns({"attempts": F.lit(attempt + 1), "faithful": F.coalesce(faithful(F.col("kind"), F.lit(category)), F.lit(False))}), "drawn")
        last = attempt + 1 == max_draws
        done = (made if last else made.filter("faithful")).drop("_n")
        out = done if out is None else out.unionByName(done)
        if not last:
            left = sources.join(made.filter("NOT faithful").select("_n"), "_n", "left_semi").select(*again)
    return out


def without_artifacts(mix: Mix) -> Mix:
    """The mix whose samples pair with this one's: the same seed draws the same, up to the artifacts."""
    return replace(mix, artifacts=0.0)
