"""Column expressions, exact quantiles, ranks and the numeric kernels used inside tasks."""
