"""All registered queries. Importing the modules registers them."""

from catalogue import checks, discovery, drift, files, profile
from catalogue.registry import ORACLES, QUERIES
