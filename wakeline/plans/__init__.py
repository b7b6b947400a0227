from wakeline.plans.routes import edges, steps, summary, top_routes, totals

__all__ = ["edges", "steps", "summary", "top_routes", "totals"]
