"""larder — restaurant stock, menu and sales analytics on Spark.

Tables (suppliers, ingredients, purchases, menu_items, recipes, customers,
employees, orders, order_items, users) are plain DataFrames.  Reports, audits,
change jobs and stock keeping are functions ``DataFrame(s) -> DataFrame`` built
from the DataFrame / SQL API so Catalyst plans them and they scale out.
"""

from larder.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
