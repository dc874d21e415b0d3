
from fleetlens.plans import catalog, durability, extended, reports, scheduling, stored, timed, trusted  # noqa: F401
