"""flowlab: network-flow tables and federated-experiment data on Spark."""
