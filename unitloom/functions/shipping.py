"""Makes the batch helpers travel with the closures that use them."""

from pyspark import cloudpickle

from unitloom.functions import block_max, kernels, marking, meeting

# Executors then need no copy of this package on their import path.
for module in (block_max, kernels, marking, meeting):
    cloudpickle.register_pickle_by_value(module)
