"""linkloom: goal-directed crawl analytics as Spark DataFrame jobs.

Pages, links, plans, jobs and events are tables; every operator takes and
returns a DataFrame (or builds a Column), so Catalyst plans the work.
"""

__version__ = "0.1.0"
