"""landcube.plans"""
