"""Multi-state models: a row for each transition that an interval is at risk of, in strata by transition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.plans.cox import CoxModel, cox_fit


@dataclass(frozen=True)
class Transition:
    """From a state to another. terms: covariates and the labels of their coefficients; transitions with the same label share a coefficient."""

    before: object
    after: object
    terms: Mapping[str, str] | Sequence[str]

    @property
    def name(self) -> str:
        return f"{self.before}:{self.after}"

    def labels(self) -> dict[str, str]:
        """By covariate; those without a label of their own get one of this transition."""
        return dict(self.terms) if isinstance(self.terms, Mapping) else {c: f"{c}_{self.name}" for c in self.terms}


def coefficients(transitions: Sequence[Transition]) -> list[str]:
    """The labels of all coefficients, in order of appearance."""
    return list(dict.fromkeys(label for t in transitions for label in t.labels().values()))


def stack(df: DataFrame, transitions: Sequence[Transition], state: str = "state", after: str = "after", start: str = "start", stop: str = "stop") -> DataFrame:
    """(transition, start, stop, event, __c0, __c1, ...): a row for each transition out of an interval's state, the event if that is where it went.

    after is the state at stop, null where none was reached. __ci is the sum of the covariates that have the i-th coefficient in the transition, else 0. One pass over df, whose rows make as
    many rows as their state has transitions; null states make none.
    """
    if len({t.name for t in transitions}) < len(transitions):
        raise ValueError("transitions must differ")
    labels = coefficients(transitions)

    def of(t: Transition):
        sums = []
        for i, label in enumerate(labels):
            total = F.lit(0.0)
            for c, own in t.labels().items():
                total = total + F.col(c).cast("double") if own == label else total
            sums.append(total.alias(f"__c{i}"))
        event = F.coalesce(F.col(after) == F.lit(t.after), F.lit(False)).cast("int").alias("event")
        return F.when(F.col(state) == F.lit(t.before), F.struct(F.lit(t.name).alias("transition"), event, *sums))

    rows = F.filter(F.array(*[of(t) for t in transitions]), lambda x: x.isNotNull())
    return df.select(F.col(start).alias("start"), F.col(stop).alias("stop"), F.inline(rows))


def multistate_fit(df: DataFrame, transitions: Sequence[Transition], state: str = "state", after: str = "after", start: str = "start", stop: str = "stop", risk_set: str = "interval", **options) -> CoxModel:
    """One likelihood over all transitions, each with its own risk sets and baseline; options are cox_fit's."""
    labels = coefficients(transitions)
    rows = stack(df, transitions, state, after, start, stop)
    model = cox_fit(rows, [f"__c{i}" for i in range(len(labels))], "stop", "event", "start", risk_set=risk_set, strata="transition", **options)
    return replace(model, covariates=tuple(labels))
