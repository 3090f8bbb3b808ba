"""Print the physical plan of a registered query, e.g.

    python tools/explain.py analyze_emails [sf_dir] [--static]

``--static`` turns AQE off so the plan shape (exchanges, broadcasts,
pushed filters, read schemas) is shown before runtime re-planning.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailrisk.plans.catalog import REGISTRY  # noqa: E402
from mailrisk.session import get_session  # noqa: E402


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    name = args[0] if args else "analyze_emails"
    sf_dir = args[1] if len(args) > 1 else "/root/testdata/sf0.01"
    spark = get_session("mailrisk-explain")
    if "--static" in sys.argv:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    REGISTRY[name][0](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
