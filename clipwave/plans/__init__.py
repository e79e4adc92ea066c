"""clipwave.plans"""
