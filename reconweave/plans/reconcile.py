"""The whole reconciliation as stages over the entity tables, for all merchants at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconweave.functions.durable import written
from reconweave.operators import adjustments, decompose, fees, investigate, ledger, matching, netting

STAGES = ("exact", "repair", "model", "global", "netting", "agent")
# The stages that each preset turns on; the last two leave references out, so that only scores link.
PRESETS = {
    "deterministic": ("exact",),
    "repair": ("exact", "repair"),
    "scorer": ("exact", "repair", "model"),
    "global": ("exact", "repair", "model", "global"),
    "netting": ("exact", "repair", "model", "global", "netting"),
    "full": ("exact", "repair", "model", "global", "netting", "agent"),
    "stress_greedy": ("model", "netting", "agent"),
    "stress_global": ("model", "global", "netting", "agent"),
}


class Reconciliation:
    """Stages on demand; each expensive one is written once and reread by those after it.

    ``probability`` is a trained pair model (see ``scorer.trained``), used by
    the presets with the model stage; without one the prior scores pairs.
    ``like`` is a run over the same tables; equal stages of such runs are made once.
    """

    def __init__(self, tables: dict[str, DataFrame], preset: str = "full", probability: Callable[[DataFrame], DataFrame] | None = None,
        like: Reconciliation | None = None):
        self.t = tables
        self.on = set(PRESETS[preset])
        self.probability = probability if "model" in self.on else None
        self.made: dict = like.made if like is not None else {}

    def once(self, key: object, make: Callable[[], object]):
        """What ``make`` gives, made once for all runs that share stages."""
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    @property
    def terms(self) -> DataFrame | None:
        """Each merchant's terms, if the tables have them; without, the standard ones hold."""
        try:
            return self.t["terms"]
        except KeyError:
            return None

    @property
    def matched(self) -> dict[str, DataFrame]:
        stages = ["exact" in self.on, "repair" in self.on, "global" in self.on]
        washed = self.once("washed", lambda: matching.without_washed(self.t["bank"]))
        return self.once((*stages, self.probability), lambda: matching.match(*washed, self.t["settlement"], self.t["cal"], *stages, self.probability))

    @property
    def _netted(self) -> tuple[DataFrame, DataFrame]:
        """The members with what is read of their payments, and the proofs."""
        return self.once("netted", lambda: netting.netting(self.t["payment"], self.t["settlement"], self.t["cal"], carry=fees.FACTS))

    @property
    def netted(self) -> bool:
        return "netting" in self.on

    @cached_property
    def members(self) -> DataFrame:
        """Payments of each batch whose members are proved."""
        return self._netted[0].drop(*fees.FACTS) if self.netted else self.t["bank"].sparkSession.createDataFrame([], netting.MEMBERS)

    @property
    def proofs(self) -> DataFrame | None:
        return self._netted[1] if self.netted else None

    @property
    def facts(self) -> DataFrame:
        """The members with what is read of their payments, by all that follows."""
        return self._netted[0] if self.netted else fees.with_facts(self.members, self.t["payment"], *fees.FACTS)

    @property
    def tied(self) -> DataFrame:
        return self.once(("tied", self.netted), lambda: written(netting.swap_invariant(self.facts, self.t["payment"], self.t["rate"])))

    @property
    def attributed(self) -> DataFrame:
        def make() -> DataFrame:
            all_ = adjustments.adjustments(self.t["refund"], self.t["chargeback"], self.t["reserve"], self.t["cal"])
            windows = adjustments.cycle_windows(self.facts, self.t["payment"])
            return written(adjustments.attribute(adjustments.attach_dates(all_, self.t["settlement"]), windows))

        return self.once(("attributed", self.netted), make)

    @property
    def fees(self) -> DataFrame:
        """Sums of fees per batch, which hold whatever credits are linked."""
        return self.once(("fees", self.netted), lambda: written(fees.batch_fees(self.facts, self.t["rate"], self.terms)))

    @cached_property
    def deducted(self) -> DataFrame:
        return adjustments.deductions(self.attributed, adjustments.settled_separately(self.matched["parsed"]))

    @cached_property
    def decomposition(self) -> DataFrame:
        m, t = self.matched, self.t
        return written(decompose.decompose(t["settlement"], t["bank"], m["links"], self.facts, t["payment"], t["rate"], self.deducted,
            self.tied, m["candidates"], self.netted, self.terms, self.fees))

    @cached_property
    def exceptions(self) -> DataFrame:
        return written(decompose.exceptions(self.decomposition, self.attributed, self.proofs))

    @cached_property
    def signals(self) -> DataFrame:
        """Each exception with what the lookups found."""
        return written(investigate.signals(self.exceptions, self.facts, self.t, self.matched["parsed"]))

    @cached_property
    def classified(self) -> DataFrame:
        return written(investigate.idempotency(investigate.classify(self.signals)))

    def decided(self, seen: DataFrame | None = None) -> DataFrame:
        """Verdicts; ``seen`` is the ledger so far, whose keys are not decided again."""
        return investigate.decide(investigate.gates(self.classified, seen))

    @cached_property
    def verdicts(self) -> DataFrame:
        """``decided`` on an empty ledger."""
        return written(self.decided())

    def ledger(self, before: DataFrame | None = None) -> DataFrame:
        return ledger.append(before, ledger.entries(self.verdicts if before is None else self.decided(before)))

    @property
    def residues(self) -> DataFrame:
        return self.decomposition.select("merchant_id", "settlement_id", "bank_txn_id", "gross", "predicted", "residue", "membership_proven",
            "within_tolerance", "ambiguous")

    @property
    def figures(self) -> DataFrame:
        """The totals of links and residues, for which nothing needs to be decided."""
        return decompose.run_totals(self.decomposition, self.members)

    @property
    def totals(self) -> DataFrame:
        return decompose.run_totals(self.decomposition, self.members, self.verdicts if "agent" in self.on else None)


def reconcile(tables: dict[str, DataFrame], preset: str = "full", probability: Callable[[DataFrame], DataFrame] | None = None) -> dict[str,
    DataFrame]:
    """Result tables of one run."""
    r = Reconciliation(tables, preset, probability)
    return {
        "payment_link": r.members, "bank_link": r.matched["links"], "decomposition": decompose.components_long(r.decomposition),
            "exception": r.verdicts,
        "candidate": r.matched["candidates"], "totals": r.totals.withColumn("preset", F.lit(preset)),
    }
