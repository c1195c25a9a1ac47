"""caseloom: document and e-mail analytics on Spark DataFrames."""

from caseloom.session import share_code

__version__ = "0.1.0"

share_code()
