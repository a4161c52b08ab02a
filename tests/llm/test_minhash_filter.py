from __future__ import annotations

from math import ceil, comb

from tidetrace.llm.minhash import Plan


def test_signature_check_loses_no_link():
    """A pair at the threshold agrees in enough places of its signature but for a chance far below that of the bands."""
    plan, p = Plan(), Plan().percent / 100
    n = plan.bands * plan.rows
    lost = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(ceil(n * plan.least)))
    assert lost < 1e-7
