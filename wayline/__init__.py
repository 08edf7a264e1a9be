"""wayline: travel-CRM analytics and change-set processing on Spark DataFrames.

Every public function takes DataFrames (plus plain parameters such as an
``as_of`` date or a page number) and returns a DataFrame.  Nothing is
collected to the driver on a data path; the work is planned by Catalyst and
run by Spark executors.
"""

from wayline.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
