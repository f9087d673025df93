"""No streaming operators: the analytics are defined over complete tables only."""
