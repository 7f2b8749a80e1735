"""Per-session build context: derives the subscription tables from the driver
tables once, writes them (and the feature view) under the checkpoint folder,
and hands lazily evaluated DataFrames to the query plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import offers as OF
from ..operators import scenarios as SC
from ..operators import survival as SV
from ..operators import value as VL
from ..params import Settings, driver_settings
from ..session import ensure_checkpoint_dir, materialize
from ..sources import roles as R
from ..sources.tables import table

_CACHE: dict[tuple, "Context"] = {}


@dataclass
class Context:
    spark: SparkSession
    sf_dir: str
    settings: Settings
    _memo: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _once(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    # ------------------------------------------------------------ base tables
    def roles(self) -> R.Roles:
        def build():
            return R.from_orders(self.spark, self.sf_dir, self.settings.services,
                                 self.settings.adapter, persist=materialize)
        return self._once("roles", build)

    @property
    def customer(self) -> DataFrame:
        return self.roles().customer

    @property
    def account(self) -> DataFrame:
        return self.roles().account

    @property
    def service(self) -> DataFrame:
        return self.roles().service

    def features(self) -> DataFrame:
        def build():
            fv = FT.feature_view(self.customer, self.account, self.service,
                                 self.settings.services, self.settings.features)
            return materialize(fv, "feature_customer")
        return self._once("features", build)

    def km_factors(self) -> DataFrame:
        def build():
            e = self.settings.economics
            curve = SV.km_curve(self.account, "tenure_months", "churned", "contract_type")
            return materialize(SV.discounted_factor(curve, e.horizon_months,
                                                    e.monthly_discount_rate), "km_factors")
        return self._once("km_factors", build)

    def scored(self) -> DataFrame:
        return self._once("scored", lambda: VL.tenure_score(self.features()))

    def customer_value(self) -> DataFrame:
        def build():
            cv = VL.customer_value(self.scored(), self.km_factors(), self.settings.economics)
            return materialize(cv, "customer_value")
        return self._once("customer_value", build)

    def assigned(self) -> DataFrame:
        """The offer of every customer; written, since each strategy reads it."""
        return self._once("assigned", lambda: materialize(OF.assign_offers(
            self.customer_value(), self.settings.offers), "assigned"))

    def greedy(self) -> DataFrame:
        """The ROI-greedy selection under the budget (D8); already written to
        the checkpoint folder by the distributed running sum."""
        return self._once("greedy", lambda: OF.greedy_roi(
            self.assigned(), self.settings.economics.budget))

    def scenario_results(self) -> DataFrame:
        def build():
            s = self.settings
            r = SC.scenario_results(self.customer_value(), s.economics, s.offers, s.sweeps)
            return materialize(r, "scenario_results")
        return self._once("scenario_results", build)

    def test_set(self) -> DataFrame:
        """Held-out 20 % (stratified, md5 order) of the scored population."""
        def build():
            from ..operators.evaluate import stratified_split
            sp = stratified_split(self.customer_value(), "churned", self.settings.seed)
            return materialize(sp, "split")
        return self._once("split", build)

    def model_input(self) -> DataFrame:
        """Model columns plus the held-out flag of the shared stratified split."""
        def build():
            from ..operators import model as MD
            flags = self.test_set().select("customer_id", "is_test")
            # written once: every fit (imputer, scaler, indexer, L-BFGS passes)
            # re-reads it instead of re-running the join
            return materialize(MD.prepare(self.features()).join(flags, "customer_id"),
                               "model_input")
        return self._once("model_input", build)

    def models(self) -> dict:
        """Raw and fold-calibrated logistic, trained once for the same rows."""
        def build():
            from ..operators import model as MD
            p = MD.ModelParams(seed=self.settings.seed)
            train = self.model_input().filter(~F.col("is_test"))
            return {"params": p} | MD.trained(train, p)
        return self._once("models", build)

    def forest(self):
        def build():
            from ..operators import model as MD
            p = MD.ModelParams(seed=self.settings.seed)
            train = self.model_input().filter(~F.col("is_test"))
            return MD.fit_forest(train, p)
        return self._once("forest", build)

    def register_views(self) -> list[str]:
        """Replaceable temp views over the shared tables, so the same data can
        be queried with ``spark.sql`` (S4)."""
        views = {"customer": self.customer, "account": self.account,
                 "service_subscription": self.service, "feature_customer": self.features(),
                 "tenure_churn_gradient": FT.tenure_gradient(self.account)}
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return list(views)

    def memo(self, key: str, build):
        return self._once(key, build)


def context(spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> Context:
    """The cached context for this session and data folder."""
    ensure_checkpoint_dir(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), id(settings))
    ctx = _CACHE.get(key)
    if ctx is None or ctx.spark is not spark:
        ctx = Context(spark, sf_dir.rstrip("/"), settings or driver_settings())
        _CACHE[key] = ctx
    return ctx
