"""Features, gate and value over the flat extract; planted faults fail their check."""


import pytest

from holdfast.operators import features as FT
from holdfast.operators import quality as QC
from holdfast.operators import survival as SV
from holdfast.operators import value as VL
from holdfast.params import Economics, QualityParams
from holdfast.sources import roles as R
from holdfast.sources.tables import RAW_CUSTOMER_SCHEMA, read_csv

COLUMNS = [f.name for f in RAW_CUSTOMER_SCHEMA]


def extract():
    """60 customers whose tenure, charge and services follow from their number."""
    rows = []
    for i in range(60):
        internet = ("DSL", "Fiber optic", "No")[i % 3]
        addon = "No internet service" if internet == "No" else ("Yes", "No")[i // 3 % 2]
        phone = "No" if i % 5 == 0 and internet != "No" else "Yes"
        tenure, charge = 1 + i % 13 * 5, 20.0 + i * 7 % 90
        rows.append(dict(zip(COLUMNS, [
            f"c{i:02d}", ("Female", "Male")[i % 2], i % 4 // 3, ("Yes", "No")[i // 2 % 2],
            ("No", "Yes")[i // 4 % 2], tenure, phone,
            "No phone service" if phone == "No" else "Yes", internet, *[addon] * 6,
            ("Month-to-month", "One year", "Two year")[i // 2 % 3], ("Yes", "No")[i % 2],
            ("Electronic check", "Mailed check", "Bank transfer (automatic)",
             "Credit card (automatic)")[i % 4],
            charge, str(tenure * charge), ("No", "No", "Yes")[i // 3 % 3]])))
    return rows


def roles(spark, tmp_path, rows):
    path = str(tmp_path / "extract")
    spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], RAW_CUSTOMER_SCHEMA) \
        .write.option("header", True).csv(path)
    raw = read_csv(spark, path)
    return R.from_flat_file(raw), raw


def failed(spark, tmp_path, rows, days=1.0):
    r, raw = roles(spark, tmp_path, rows)
    f = FT.feature_view(r.customer, r.account, r.service, R.FLAT_SERVICE_ROLES)
    checks = QC.run_checks(f, r.customer, r.account, r.service, R.FLAT_SERVICE_ROLES,
                           QualityParams(check_days_after_load=days), raw).collect()
    assert len(checks) == 47
    return {c["name"] for c in checks if not c["passed"]}


def test_clean_extract_passes(spark, tmp_path):
    assert failed(spark, tmp_path, extract()) == set()


FAULTS = {
    "total blank in mid-life": (dict(TotalCharges=" "), {"tenure0_iff_null_total",
                                                         "nonnull:total_charges"}),
    "charge of nothing": (dict(MonthlyCharges=0.0, TotalCharges="0"),
                          {"monthly_charges_positive"}),
    "charge out of range": (dict(MonthlyCharges=900.0, TotalCharges="54000"),
                            {"monthly_charges_in_range"}),
    "tenure out of range": (dict(tenure=90, TotalCharges="8100"), {"tenure_in_range"}),
    "unknown gender": (dict(gender="?"), {"domain:gender"}),
    "unknown payment": (dict(PaymentMethod="Cash"), {"domain:payment_method"}),
    "add-on without internet": (dict(InternetService="No", TechSupport="Yes"),
                                {"internet_dependency"}),
    "unknown churn": (dict(Churn="maybe"), {"nonnull:churned"}),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_a_planted_fault_fails_its_check(spark, tmp_path, fault):
    change, want = FAULTS[fault]
    rows = extract()
    rows[10] |= change
    assert failed(spark, tmp_path, rows) == want


def test_repeated_customer_and_stale_load(spark, tmp_path):
    rows = extract()
    found = failed(spark, tmp_path, rows + rows[:1], days=40.0)
    assert "load_age_within_sla" in found
    assert {n for n in found if "key" in n or "unique" in n or "dup" in n}


def test_value_chain_on_the_extract(spark, tmp_path):
    r, _ = roles(spark, tmp_path, extract())
    e = Economics()
    f = FT.feature_view(r.customer, r.account, r.service, R.FLAT_SERVICE_ROLES)
    curve = SV.km_curve(r.account, "tenure_months", "churned", "contract_type")
    factors = SV.discounted_factor(curve, e.horizon_months, e.monthly_discount_rate)
    v = VL.customer_value(VL.tenure_score(f), factors, e)
    rows = v.collect()
    assert sorted(x["customer_id"] for x in rows) == [x["customerID"] for x in extract()]
    by_id = {x["grp"]: x["factor"] for x in factors.collect()} if "grp" in factors.columns else None
    for x in rows:
        assert x["ltv"] >= 0 and x["value_at_risk"] == pytest.approx(
            x["churn_probability"] * x["ltv"], abs=0.006)
        if by_id:
            assert x["km_expected_months"] == by_id[x["contract_type"]]
    held = {x["customer_id"]: x for x in f.collect()}
    assert (held["c01"]["internet_type"], held["c01"]["fiber_flag"]) == ("Fiber optic", 1)
    assert held["c05"]["has_internet"] == 0 and held["c05"]["services_held"] == 2
