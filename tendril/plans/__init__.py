"""Registered queries over the given tables, with their SQL counterparts."""


def load():
    """Import every query module and return the registry."""
    from tendril.plans import registry
    from tendril.plans import assignments, contours, graphfiles, graphs, matching, series, topology, voxels  # noqa: F401

    return registry
