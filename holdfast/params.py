"""Parameters of every operator, gathered in one place.

Operators never hard-code a number: they receive one of these frozen
dataclasses.  The defaults reproduce the reference behaviour; the
``for_driver_tables()`` helpers rescale the money figures to the synthetic
order tables, whose charges are about a thousand times larger.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
#   economics: gross margin 0.60, monthly discount rate 0.008, horizon 24 months,
#              offer cost 120, acceptance 0.35, budget 100000
#   offers (name, cost, base acceptance):
#              Courtesy call 40 0.15; Protection bundle 120 0.35; Bill discount 220 0.45
#   protected customers take the protection bundle at 0.6 x acceptance; cap 0.95
#   service statuses that mean "not held": No, No phone service, No internet service
#   tenure bucket edges 12, 24, 48 (labels 00-12, 13-24, 25-48, 49+); loyalty split 24
#   value tiers 40 and 80 (Low / Mid / High); high value above 80
#   risk score 2*[month-to-month] + [electronic check] + [tenure <= 12]; >=3 High, >=1 Medium
#   quality: freshness SLA 30 days, total-charges null allowance 0.01,
#            tolerance 5 %, soft pass share 0.75, tenure 0..72, monthly charge 0..200,
#            leakage alarm 0.95
#   survival horizons 12, 24, 48, 72
#   hypothesis alpha 0.05; Cramer's V bands 0.1, 0.3; Cohen's d bands 0.2, 0.5, 0.8
#   profit thresholds 0.00..1.00 step 0.01; threshold sweep 0.10..0.90 step 0.05
#   sweeps: acceptance scale 0.4 0.6 0.8 1.0 1.2 1.4 1.6; offer-cost multiplier
#           0.5 0.75 1.0 1.5 2.0 3.0; gross margin 0.4 0.5 0.6 0.7 0.8;
#           budget 25000 50000 100000 150000 200000 400000
#   two-way grid: acceptance 0.4 0.7 1.0 1.3 1.6 x cost 0.5 1.0 1.5 2.0 3.0
#   named scenarios (acceptance scale, cost multiplier, margin):
#           pessimistic 0.6 1.5 0.50; base 1.0 1.0 0.60; optimistic 1.3 0.75 0.70
#   budget response: 10000 25000 50000 75000 100000 150000 200000 300000
#   saturation: first budget with utilisation below 99 %
#   experiment: alpha 0.05 two-sided, power 0.80, effects 5 10 15 20 30 %
# ---------------------------------------------------------------------------

NOT_HELD = ("No", "No phone service", "No internet service")


@dataclass(frozen=True)
class Economics:
    gross_margin: float = 0.60
    monthly_discount_rate: float = 0.008
    horizon_months: int = 24
    offer_cost: float = 120.0
    acceptance_rate: float = 0.35
    budget: float = 100_000.0

    def scaled(self, money: float) -> "Economics":
        return replace(self, offer_cost=self.offer_cost * money,
                       budget=self.budget * money)


@dataclass(frozen=True)
class Offer:
    name: str
    cost: float
    base_acceptance: float
    protection: bool = False   # acceptance drops for already-protected customers


@dataclass(frozen=True)
class OfferCatalog:
    offers: tuple[Offer, ...] = (
        Offer("Courtesy call", 40.0, 0.15),
        Offer("Protection bundle", 120.0, 0.35, protection=True),
        Offer("Bill discount", 220.0, 0.45),
    )
    protected_modifier: float = 0.6
    acceptance_cap: float = 0.95

    def scaled(self, money: float) -> "OfferCatalog":
        return replace(self, offers=tuple(replace(o, cost=o.cost * money)
                                          for o in self.offers))


@dataclass(frozen=True)
class ServiceRoles:
    """Which service names play which role in the feature view."""
    services: tuple[str, ...]
    phone: str
    internet: str
    internet_held: tuple[str, ...]      # statuses meaning "has internet"
    fiber_status: str                   # status meaning the premium internet tier
    streaming: tuple[str, ...]
    protection: tuple[str, ...]
    not_held: tuple[str, ...] = NOT_HELD
    phone_addons: tuple[str, ...] = ()  # add-ons that need no internet

    @property
    def addons(self) -> tuple[str, ...]:
        return tuple(s for s in self.services if s not in (self.phone, self.internet))

    @property
    def internet_addons(self) -> tuple[str, ...]:
        """Add-ons that cannot be held without internet."""
        return tuple(s for s in self.addons if s not in self.phone_addons)


@dataclass(frozen=True)
class FeatureParams:
    tenure_edges: tuple[int, int, int] = (12, 24, 48)
    tenure_labels: tuple[str, str, str, str] = ("00-12", "13-24", "25-48", "49+")
    value_tiers: tuple[float, float] = (40.0, 80.0)
    high_risk_contract: str = "Month-to-month"
    contract_risk: tuple[tuple[str, int], ...] = (
        ("Month-to-month", 3), ("One year", 2), ("Two year", 1))
    risk_payment: str = "Electronic check"
    new_customer_tenure: int = 12
    loyalty_split: int = 24
    arpu_deciles: int = 10
    tenure_quantiles: int = 4


@dataclass(frozen=True)
class QualityParams:
    freshness_sla_days: float = 30.0
    check_days_after_load: float | None = None      # None: checked now
    total_null_allowance: float = 0.01
    total_tolerance: float = 0.05
    soft_pass_share: float = 0.75
    tenure_range: tuple[int, int] = (0, 72)
    charge_range: tuple[float, float] = (0.0, 200.0)
    leakage_alarm: float = 0.95
    contract_domain: tuple[str, ...] = ("Month-to-month", "One year", "Two year")
    payment_domain: tuple[str, ...] = ("Electronic check", "Mailed check",
                                       "Bank transfer (automatic)",
                                       "Credit card (automatic)")
    gender_domain: tuple[str, ...] = ("Female", "Male")
    model_excludes: tuple[str, ...] = ("customer_id", "churned")


@dataclass(frozen=True)
class SweepParams:
    acceptance_scales: tuple[float, ...] = (0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6)
    cost_multipliers: tuple[float, ...] = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
    margins: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8)
    budgets: tuple[float, ...] = (25_000, 50_000, 100_000, 150_000, 200_000, 400_000)
    grid_scales: tuple[float, ...] = (0.4, 0.7, 1.0, 1.3, 1.6)
    grid_multipliers: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 3.0)
    named: tuple[tuple[str, float, float, float], ...] = (
        ("pessimistic", 0.6, 1.5, 0.50),
        ("base", 1.0, 1.0, 0.60),
        ("optimistic", 1.3, 0.75, 0.70),
    )
    response_budgets: tuple[float, ...] = (10_000, 25_000, 50_000, 75_000, 100_000,
                                           150_000, 200_000, 300_000)
    saturation_utilisation: float = 99.0
    break_even_range: tuple[float, float] = (0.01, 1.0)

    def scaled(self, money: float) -> "SweepParams":
        return replace(self,
                       budgets=tuple(b * money for b in self.budgets),
                       response_budgets=tuple(b * money for b in self.response_budgets))


@dataclass(frozen=True)
class AdapterParams:
    """How the order tables are read as a subscription business."""
    label_window_days: int = 180      # orders after max(date) - 180 d form the label
    service_window_days: int = 365    # a service is current if bought in the last year
    tenure_unit_days: int = 30
    partner_balance: float = 5000.0   # c_acctbal >= this -> has_partner
    cutoff: str | None = None         # explicit 'YYYY-MM-DD HH:MM:SS' overrides the rule


@dataclass(frozen=True)
class Settings:
    economics: Economics = field(default_factory=Economics)
    offers: OfferCatalog = field(default_factory=OfferCatalog)
    features: FeatureParams = field(default_factory=FeatureParams)
    quality: QualityParams = field(default_factory=QualityParams)
    sweeps: SweepParams = field(default_factory=SweepParams)
    adapter: AdapterParams = field(default_factory=AdapterParams)
    services: ServiceRoles | None = None
    horizons: tuple[int, ...] = (12, 24, 48, 72)
    alpha: float = 0.05
    seed: int = 42


# Role assignment for the driver's order tables (see README, "Data roles").
DRIVER_MONEY_SCALE = 1000.0
DRIVER_SERVICES = ServiceRoles(
    services=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    phone="SMALL",
    internet="LARGE",
    internet_held=("Yes", "Lapsed"),
    fiber_status="Yes",
    streaming=("PROMO", "ECONOMY"),
    protection=("STANDARD", "MEDIUM"),
)
DRIVER_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DRIVER_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
DRIVER_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def driver_settings() -> Settings:
    m = DRIVER_MONEY_SCALE
    return Settings(
        economics=Economics().scaled(m),
        offers=OfferCatalog().scaled(m),
        features=FeatureParams(
            value_tiers=(40.0 * m, 80.0 * m),
            high_risk_contract="HOUSEHOLD",
            contract_risk=(("HOUSEHOLD", 3), ("AUTOMOBILE", 2), ("MACHINERY", 2),
                           ("BUILDING", 1), ("FURNITURE", 1)),
            risk_payment="1-URGENT",
        ),
        quality=QualityParams(
            check_days_after_load=1.0,              # the given files have no load date of their own
            charge_range=(0.0, 200.0 * m),
            contract_domain=DRIVER_SEGMENTS,
            payment_domain=DRIVER_PRIORITIES,
            gender_domain=DRIVER_REGIONS,
        ),
        sweeps=SweepParams().scaled(m),
        services=DRIVER_SERVICES,
    )
