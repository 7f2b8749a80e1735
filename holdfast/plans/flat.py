"""The whole chain on a flat one-row-per-customer extract.

The subscribers are written as an extract (CSV, the layout and status values of
the raw file), read back with the explicit schema and split into the three
tables; features, gate and value then run on those, with the service roles of
the extract.  Customer ids are strings there.
"""

from __future__ import annotations

from dataclasses import replace

from ..params import Settings
from ..session import materialize
from ..sources import roles as R
from ..sources.tables import read_csv
from .context import Context
from .oracle import Oracle


def flat_settings(s: Settings) -> Settings:
    return replace(s, services=R.FLAT_SERVICE_ROLES)


def flat_context(c: Context, path: str) -> Context:
    """A context over the extract written at ``path``."""
    def build():
        R.to_extract(c.roles(), c.settings.services).write.mode("overwrite") \
            .option("header", True).csv(path)
        out = Context(c.spark, c.sf_dir, flat_settings(c.settings))
        out.memo("roles", lambda: R.from_flat_file(
            materialize(read_csv(c.spark, path), "flat_extract")))
        return out
    return c.memo("flat", build)


def flat_oracle(o: Oracle) -> Oracle:
    """The same fragments over accounts with text ids, and services whose
    status follows from what the customer bought."""
    s, out = o.s, Oracle(flat_settings(o.s))
    a, sv = s.adapter, s.services
    for name in ("account", "customer_role"):
        sql, deps = out.ctes[name]
        out.add(f"{name}_orders", sql, *deps)
        out.add(name, "SELECT * REPLACE (CAST(customer_id AS VARCHAR) AS customer_id) "
                      f"FROM {name}_orders", f"{name}_orders")
    out.add("bought", f"""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, service_name,
       CASE WHEN last_ts > cut.k - INTERVAL {a.service_window_days} DAY THEN 'Yes'
            ELSE 'Lapsed' END AS status FROM svc_last, cut""", "svc_last", "cut")
    plays = R.extract_names(sv)
    names = ", ".join(f"('{n}', '{plays.get(n, '')}')" for n in R.FLAT_SERVICES)
    out.add("service", f"""
SELECT a.customer_id, v.service_name, CASE
  WHEN v.service_name = 'InternetService'
    THEN CASE i.status WHEN 'Yes' THEN 'Fiber optic' WHEN 'Lapsed' THEN 'DSL' ELSE 'No' END
  WHEN v.service_name = 'MultipleLines'
    THEN CASE WHEN p.status = 'Yes' THEN 'No' ELSE 'No phone service' END
  WHEN v.service_name <> 'PhoneService' AND i.status IS NULL THEN 'No internet service'
  WHEN b.status = 'Yes' THEN 'Yes' ELSE 'No' END AS status
FROM account a CROSS JOIN (VALUES {names}) v(service_name, kind)
LEFT JOIN bought b ON b.customer_id = a.customer_id AND b.service_name = v.kind
LEFT JOIN bought i ON i.customer_id = a.customer_id AND i.service_name = '{sv.internet}'
LEFT JOIN bought p ON p.customer_id = a.customer_id AND p.service_name = '{sv.phone}'""",
            "account", "bought")
    return out
