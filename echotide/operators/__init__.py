"""DataFrame operators: preprocessing, masks and windows, curves, quantification, parametric maps."""
