"""Kernels: small Python functions turned into column expressions."""

from granary.plans.kernels import Kernel, KernelError, dsl_kernel, jit, kernel_from_source, lazyudf, validate_compiled, validate_kernel

__all__ = ["Kernel", "KernelError", "dsl_kernel", "jit", "kernel_from_source", "lazyudf", "validate_compiled", "validate_kernel"]
