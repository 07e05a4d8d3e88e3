"""No streaming operators.

The reference has no streams, watermarks or stateful operators; the
multi-round selection is a bounded batch loop (``poolpick.plans.rounds``).
"""
